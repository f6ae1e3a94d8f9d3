"""Operators against brute force, their own other path, and held-out rows."""

import random
import re

import brute
import harness
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
import corpus_pipeline
from filegrain.llm import decontaminate, html_text, langid, mixing, neardup, toxicity, urls, vectors
from filegrain.llm.registry import table

WIDE = "/root/testdata/sf0.01"  # enough labelled rows to measure accuracy on those held out


@pytest.fixture(scope="module")
def queries():
    return entry_point.queries()


def test_decontamination_without_broadcast(spark, sf_dir, con):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    fn = lambda *_: decontaminate.contaminated(docs, items, broadcast_windows=0)
    assert harness.compare(spark, con, fn, decontaminate.SQL, sf_dir) is None


def test_decontamination_of_short_and_long_items(spark):
    items = spark.createDataFrame([(1, "one"), (2, "one two"), (3, "c d e f g h i j k l m"), (30, "d e f g h i j k l m")], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, "ONE two one"), (2, "a b c d e f g h i j k l m n"), (3, "c d e f g h i j k x d e f g h i j k l"), (4, "café-one 3")], "doc_id long, text string"
    )
    for limit in (0, 1000):
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontaminate.contaminated(docs, items, broadcast_windows=limit).collect()}
        assert got == {1: (3, 3, 2), 2: (14, 11, 2), 3: (19, 0, 0), 4: (3, 1, 1)}


def variants(seed, groups, of_each, words, edits):
    rng = random.Random(seed)
    out, n = {}, 0
    for _ in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(words)]
        for _ in range(of_each):
            text = list(base)
            for _ in range(rng.randrange(edits + 1)):
                text[rng.randrange(words)] = f"v{rng.randrange(10**6)}"
            out[n], n = " ".join(text), n + 1
    return out


@pytest.mark.parametrize("weight", [1 << 21, 9000])
def test_near_duplicates(spark, monkeypatch, weight):
    """Similarities on both sides of the threshold; with a small weight clusters are compared in pairs of blocks."""
    monkeypatch.setattr(neardup, "UNIT_WEIGHT", weight)
    texts = variants(3, 6, 40, 120, 4) | {1000: "a b c", 1001: "A b c", 1002: "a b", 1003: ""}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs).collect()}
    want = brute.near_duplicates(texts)
    assert got == want and 20 < len({c for _, c in want.values()}) < 200


def test_near_duplicates_from_080(spark):
    """Pairs between 0.80 and 0.85, each with words of its own: one changed word of 55 takes 5 of 51 shingles."""
    texts = {}
    for n in range(20):
        base = [f"w{n}x{k}" for k in range(55)]
        texts |= {2 * n: " ".join(base), 2 * n + 1: " ".join([*base[:20], "changed", *base[21:]])}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = {r.doc_id for r in neardup.one_of_each(docs, percent=80).collect()}
    assert kept == {2 * n for n in range(20)} == {i for i, (_, c) in brute.near_duplicates(texts, 80).items() if i == c}
    assert neardup.banding(85) == (7, 36) and neardup.banding(80) == (6, 46)


def test_near_duplicates_of_the_supplied_table(spark, sf_dir, queries):
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries["op3_near_duplicates"](spark, sf_dir).collect()}
    assert got == brute.near_duplicates(texts)


def test_signature_values_estimate_similarity():
    import numpy as np

    draw = np.random.default_rng(1).integers(0, 1 << 63, 400, dtype=np.uint64)
    a, b = neardup.min_max(draw[:360]), neardup.min_max(draw[40:])
    half = neardup.PERMUTATIONS
    assert abs((a == b).mean() - 0.8) < 0.1 and (a[:half] == b[:half]).any() and (a[half:] == b[half:]).any()


def test_vectors(spark):
    rng = random.Random(5)
    base = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(60)]
    rows = {n: [x + rng.gauss(0, 0.22) for x in base[n % 60]] for n in range(900)} | {900 + n: [2 * x for x in base[n]] for n in range(20)}
    df = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in rows.items()], "vec_id long, embedding array<float>")
    stored = {r.vec_id: list(r.embedding) for r in df.collect()}
    want = brute.near_vectors(stored)
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(df).collect()}
    true, found = sum(n for n, _ in want.values()), sum(n for n, _ in got.values())
    assert true > 2000 and 0.98 * true <= found <= true
    assert sum(got[i][1] == want[i][1] for i in want) >= 0.98 * len(want)
    assert all(got[i][0] <= want[i][0] for i in want)


def test_vector_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD_ROWS", 150)
    monkeypatch.setattr(vectors, "QUERY_ROWS", 100)
    rng = random.Random(6)
    base = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    df = spark.createDataFrame([(n, [x + rng.gauss(0, 0.1) for x in base[n % 12]]) for n in range(600)], "vec_id long, embedding array<float>")
    got = vectors.recall_audit(df, every=7).first()
    assert got.queries == 86 and got.true_links > 1000 and got.recall >= 0.95


def test_links_planted_over_hundreds_of_centres(spark, monkeypatch):
    """Links at the threshold between vectors without clusters, the worst case for shards."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(vectors, "ROWS_PER_CENTRE", 20)
    monkeypatch.setattr(vectors, "SAMPLED_PER_CENTRE", 4)
    rng = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x = unit(rng.normal(size=(6000, 64)))
    aside = rng.normal(size=x.shape)
    aside = unit(aside - (aside * x).sum(1, keepdims=True) * x)
    rows = np.concatenate([x, 0.901 * x + np.sqrt(1 - 0.901**2) * aside]).astype(np.float32)
    lists = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), 64).cast(pa.list_(pa.float32()))
    df = spark.createDataFrame(pa.table({"vec_id": pa.array(range(len(rows)), pa.int64()), "embedding": lists}))
    got = {r.vec_id: r.n_links for r in vectors.near_vectors(df).collect()}
    assert sum(got.values()) >= 0.95 * len(rows)


def test_recall_of_the_supplied_table(spark, sf_dir, queries):
    assert queries["near_vectors_recall"](spark, sf_dir).first().recall >= 0.9


def test_mixing_keeps_every_prefix_within_a_block(spark, sf_dir, queries):
    rows = sorted(queries["op8_source_mix"](spark, sf_dir).collect(), key=lambda r: r.mix_position)
    assert len({r.doc_id for r in rows}) == len(rows) == table(spark, sf_dir, "documents").count()
    assert len({r.mix_position for r in rows}) == len(rows)
    slots = {r.mix_slot: r.source for r in rows}
    assert sorted(slots) == list(range(len(slots))) and all(slots[r.mix_slot] == r.source for r in rows)


def test_phases_deviate_by_less_than_one_block():
    rng = random.Random(1)
    for _ in range(60):
        blocks = {f"s{i}": rng.randint(0, 200) for i in range(rng.randint(1, 10))}
        weights = {s: rng.random() ** 3 + 0.001 for s in blocks}
        plan = mixing.phases(blocks, weights, rng.choice([10, 37, 100]))
        at = {}
        for phase in plan:
            for s, slots in phase["slots"].items():
                for k in range(phase["to"][s] - phase["from"][s]):
                    at[phase["first"] + k // len(slots) * phase["size"] + slots[k % len(slots)]] = s
        assert sorted(at) == list(range(sum(blocks.values())))
        for phase, after in zip(plan, [*plan[1:], {"first": len(at)}]):
            counts = dict.fromkeys(phase["slots"], 0)
            for n in range(phase["first"], after["first"]):
                counts[at[n]] += 1
                gone = n + 1 - phase["first"]
                assert all(abs(c - gone * len(phase["slots"][s]) / phase["size"]) < 1 for s, c in counts.items())


def test_page_texts(spark, sf_dir):
    for r in table(spark, sf_dir, "pages").collect():
        page = re.sub(r"<[^>]*\Z", "", r.html)  # the parser shows a tag that is cut off as text
        assert html_text.main_text(r.html) == brute.Article.text(page), r.page_id


NOISE = (
    "<nav><ul><li>Home<li>News</ul></nav>", "<header><p>Site name</p></header>", "<div class='cookie-notice'><p>We use <b>cookies</b>.</p></div>",
    "<aside><p>Read on</p></aside>", "<form><label>Mail</label><input></form>", "<div id=comments><article class='comment'><p>First!</p></article></div>",
    "<!-- x > y --><script>if (a < b) c('</p>')</script>", "<div class=ad><div>Buy</div></div>", "<footer>&copy; Us</footer>", "<div role='navigation'>Up</div>",
)


def test_planted_page_parts():
    rng = random.Random(2)
    for n in range(300):
        texts = [" ".join(rng.choice(["alpha", "beta &lt;", "<i>gam</i>ma", "caf&eacute;", "x &amp; y", "d\n  e"]) for _ in range(rng.randint(3, 40))) for _ in range(rng.randint(1, 12))]
        parts = [f"<p>{t}</p>" for t in texts]
        for _ in range(rng.randint(0, 6)):
            parts.insert(rng.randint(0, len(parts)), rng.choice(NOISE))
        inner = "".join(parts)
        page = f"<html><head><title>T</title></head><body>{rng.choice(NOISE)}<article>{inner}</article>{rng.choice(NOISE)}</body></html>"
        want = "\n\n".join(" ".join(re.sub("</?i>", "", t).replace("&lt;", "<").replace("&eacute;", "é").replace("&amp;", "&").split()) for t in texts)
        assert html_text.main_text(page) == want, n
    plain = "<body><div><a href=/>Home</a></div><div><a href=/n>News</a></div><h1>Title</h1>" + "<p>Some words that run on for a while, as text does.</p>" * 4 + "<p>End.</p>"
    assert html_text.main_text(plain).startswith("Title\n\nSome") and html_text.main_text(plain).endswith("End.")


@pytest.mark.parametrize("attributes", [
    "style='overflow:hidden'", "class=overflow-hidden", "aria-hidden=false", "class='has-sidebar'", "class='no-sidebar'", "class='content with-sidebar'", "class=sidebar",
])
def test_wrappers_of_the_text_are_kept(attributes):
    text = "Some words that run on for a while, as text does, and then some more of them."
    body = f"<div class=site-header><p>Site</p></div><p>{text}</p><p>{text}</p><div hidden><p>Secret</p></div><div style='color:red; visibility: hidden'>Too</div>"
    for inner in (f"<article>{body}</article>", body):
        page = f"<body><div {attributes}>{inner}</div><div class=sidebar><p>Aside</p></div></body>"
        kept = html_text.main_text(page).split("\n\n")
        assert kept.count(text) == 2 and not {"Secret", "Too", "Aside"} & set(kept)
    assert html_text.main_text(f"<article {attributes.replace('class=sidebar', '')}><p>{text}</p></article>") == text


def test_short_and_linked_lines_belong_to_the_stretch_around_them():
    text = "Some words that run on for a while, as text does, and then some more of them."
    page = (
        f"<body><div><a href=/>Home</a></div><div><h1><a href=/t>Title</a></h1></div><div><p>{text}</p></div><div><h2>Part</h2></div><div><p>Short.</p></div>"
        f"<div><p><a href=/x>Linked</a></p></div><div><div><p>{text}</p></div></div><div><a href=/a>A</a></div><div><a href=/b>B</a></div></body>"
    )
    assert html_text.main_text(page).split("\n\n") == ["Title", text, "Part", "Short.", "Linked", text]


def test_templates_with_labels(spark):
    """A blocked branch takes its own unlabelled pages with it and leaves the clean branch alone."""
    rules = (("a.com", "/ads/x", "block"), ("a.com", "/news/1", "allow"))
    rows = [(n, f"http://a.com/ads/{'x' if n % 3 else 'y'}{n}") for n in range(30)] + [(100 + n, f"http://a.com/news/{10 + n}") for n in range(30)]
    got = {r.page_id: r for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), rules=rules).collect()}
    assert got[0].rule is None and got[0].verdict == "block" and got[0].template == "/ads/<any>"
    assert {got[100 + n].verdict for n in range(30)} == {"allow"}


def test_heldout_accuracy(spark, queries):
    docs, labels = table(spark, WIDE, "documents"), table(spark, WIDE, "labels")
    share = lambda df, right: df.agg(F.avg(F.expr(right).cast("int"))).first()[0]
    assert share(queries["op10_language_id"](spark, WIDE).join(docs.select("doc_id", "lang"), "doc_id").where("held_out"), "lang = lang_pred") >= 0.98
    assert share(queries["op2_quality"](spark, WIDE).join(labels, "doc_id").where("held_out"), "keep = (quality = 1)") >= 0.95
    toxic = queries["op6_toxicity"](spark, WIDE).join(labels, "doc_id").where("held_out")
    assert share(toxic, "predicted = toxic") >= 0.9 and share(toxic.where("toxic = 1"), "predicted = 1") >= 0.5


def test_pipeline(spark, sf_dir, con, queries):
    docs = {r.doc_id: r for r in table(spark, sf_dir, "documents").collect()}
    language = {r.doc_id for r in queries["op10_language_id"](spark, sf_dir).where("lang_pred <> 'und'").collect()}
    toxicity = {r.doc_id for r in queries["op6_toxicity"](spark, sf_dir).where("predicted = 0").collect()}
    left = language & toxicity if language == set(docs) else None  # the second stage then learns from the same rows
    assert left is not None
    groups = brute.near_duplicates({i: docs[i].text for i in left})
    left = {i for i in left if groups[i][1] == i}
    clean = {r[0] for r in con.execute(f"SELECT doc_id FROM ({decontaminate.SQL}) WHERE NOT contaminated").fetchall()}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in got} == left & clean and len(got) == len(left & clean)
    assert all((r.text, r.lang, r.source, r.n_chars) == docs[r.doc_id][1:] for r in got)
    assert len({r.mix_position for r in got}) == len(got)


def test_templates_decide_pages_of_the_supplied_table(spark, sf_dir):
    pages = table(spark, "/root/testdata/sf0.1", "pages")  # 2500, so that hosts have several
    got = urls.filter_urls(pages, rules=urls.LABELS).where("rule is null").groupBy("verdict").count().collect()
    assert {r.verdict: r["count"] for r in got}["block"] >= 100


def test_of_two_rules_of_one_length_the_larger_holds(spark):
    rules = (("a.com", "/x", "block"), ("com", "/xyz", "allow"), ("b.com", "/", "allow"))
    rows = [(1, "http://a.com/xyz"), (2, "http://a.com/xa"), (3, "http://a.b.com/xyz")]
    got = {r.page_id: (r.rule, r.verdict) for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), rules=rules).collect()}
    assert got == {1: ("com/xyz", "allow"), 2: ("a.com/x", "block"), 3: ("com/xyz", "allow")}


TEXT = "Some words that run on for a while, as text does, and then some more of them."


@pytest.mark.parametrize("name", "ad-slot advert-1 google_ads comment-body comment-list comments-area reader-comments cookie-bar cookieConsent".split())
def test_noise_by_any_word_of_a_name(name):
    for holder in ("article", "div"):
        page = f"<body><{holder}><p>{TEXT}</p><div class='{name}'>Noise words of some length</div><p>{TEXT}</p></{holder}><div id={name}><p>Noise {TEXT}</p></div></body>"
        assert html_text.main_text(page) == f"{TEXT}\n\n{TEXT}"


def test_articles_of_readers_are_no_articles():
    for comment in ("First!", TEXT * 5):
        page = f"<body><div class=post><p>{TEXT}</p><p>{TEXT}</p></div><div id=comments><article class=comment-body>{comment}</article></div></body>"
        assert html_text.main_text(page) == f"{TEXT}\n\n{TEXT}"
        assert html_text.main_text(f"<article><p>{TEXT}</p></article><section id=comments><article><p>{comment}</p></article></section>") == TEXT


def test_lists_of_links_fall_out():
    links = "".join(f"<li><a href={i}>Share {i}</a>" for i in range(4))
    assert html_text.main_text(f"<article><p>{TEXT}</p><ul>{links}</ul><p>{TEXT}</p><ul>{links}</ul></article>") == f"{TEXT}\n\n{TEXT}"
    assert html_text.main_text(f"<main><div><a href=1>Home</a> | <a href=2>News</a></div><h1>T</h1><p>{TEXT}</p></main>") == f"T\n\n{TEXT}"


def test_text_beside_a_teaser():
    kept = html_text.main_text(f"<body><div class=post>{f'<p>{TEXT}</p>' * 6}</div><article class=teaser><p>Read on</p></article></body>")
    assert kept.split("\n\n").count(TEXT) == 6


def planted_pairs(rng, n):
    """Rows whose label says whether their two marks agree; neither mark tells anything by itself."""
    rows, y = [], []
    for _ in range(n):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append(np.array(sorted({int(x) for x in rng.integers(1000, 3000, 30)} | {1 if a else 2, 3 if b else 4}), np.int32))
        y.append(float(a == b))
    return rows, np.array(y)


def test_pairs_are_learned_that_a_linear_model_cannot(monkeypatch):
    rng = np.random.default_rng(4)
    (rows, y), (others, wanted) = planted_pairs(rng, 3000), planted_pairs(rng, 1000)
    machine = toxicity.FactorizationMachine.fit(rows, y, np.ones(len(y)))
    right = lambda scores: ((scores >= 0.5) == (wanted == 1)).mean()
    assert right(machine.scores(others)) > 0.95
    linear = toxicity.FactorizationMachine(machine.bias, machine.linear, np.zeros_like(machine.factors))
    assert right(linear.scores(others)) < 0.6
    assert not toxicity.telling(rows, y)[1:5].any() and toxicity.telling_together(rows, y)[1:5].all()


def test_scores_of_the_machine_by_all_pairs():
    rng = np.random.default_rng(6)
    machine = toxicity.FactorizationMachine(0.3, rng.normal(0, 1, toxicity.BUCKETS), rng.normal(0, 0.3, (toxicity.BUCKETS, toxicity.FACTORS)))
    for text in ("", "One two two THREE", "über alles " * 3 + "long winded wordiness"):
        at = toxicity.terms(text)
        margin = 0.3 + sum(machine.linear[i] for i in at) + sum(float(machine.factors[i] @ machine.factors[j]) for n, i in enumerate(at) for j in at[:n])
        assert abs(machine.scores([at])[0] - 1 / (1 + np.exp(-margin))) < 1e-9


def test_signs_that_are_no_letters(spark):
    texts = {1: "½ ²", 2: "③ Ⅷ", 3: "12 + 3", 4: "½ kilo of the best bread in the whole town", 5: "the best bread in the whole town"}
    docs = spark.createDataFrame([(i, t, "en") for i, t in texts.items()] + [(10 + i, "ein Brot aus der ganzen Stadt", "de") for i in range(20)] + [(40 + i, texts[5], "en") for i in range(20)], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.language_table(docs).collect()}
    assert [got[i] for i in (1, 2, 3)] == [("und", 0.0)] * 3 and got[4][0] == got[5][0] == "en"
    assert langid.has_letter("ªª") and not langid.has_letter("_1²Ⅷ")


def test_doubles_are_compared_as_doubles(spark):
    """A cosine just above the threshold, which single precision takes for one below it."""
    x, y = [1.0, 0.0], None
    for n in range(1, 40):
        angle = np.arccos(0.9) - n * 1e-9
        y = [float(np.cos(angle)), float(np.sin(angle))]
        single = np.array(y, np.float32).astype(float)
        if y[0] / np.hypot(*y) >= 0.9 > single[0] / np.hypot(*single):
            break
    else:
        raise AssertionError("no such vector")
    rows = [(1, x), (2, y), (3, [2.0 * v for v in x])]
    for kind, links in (("double", 2), ("float", 1)):
        got = {r.vec_id: r.n_links for r in vectors.near_vectors(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")).collect()}
        assert got[1] == links


def test_pairs_that_stand_out_are_counted_in_bounded_memory(monkeypatch):
    """Toxic rows use other words than the rest, so nearly every pair stands out; four groups of words tell only together."""
    import tracemalloc

    rng = np.random.default_rng(8)
    rows, y = [], np.arange(1500) % 2.0
    for v in y:
        a, b = rng.integers(0, 2, 2)
        b = a if v else 1 - a
        rows.append(np.unique(np.r_[1 + a, 3 + b, 100 + 400 * int(v) + rng.integers(0, 400, 200)]).astype(np.int32))
    tracemalloc.start()
    whole = toxicity.telling_together(rows, y)
    assert tracemalloc.get_traced_memory()[1] < 110 << 20
    tracemalloc.stop()
    monkeypatch.setattr(toxicity, "PAIRS_AT_ONCE", 20_000)
    assert whole[1:5].all() and (toxicity.telling_together(rows, y) == whole).all()
