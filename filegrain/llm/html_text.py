"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped into lines, one for each block-level element; lines inside menus,
headers, footers, sidebars, notices, adverts, forms, scripts and reader comments are
empty. Such an element is known by its tag, its role or any word of a class or id; one of the
weaker words does not count for an element that holds the page's articles or, without
any, most of its text. An article inside an element of the stronger kind, as a reader's
comment, is no article of the page.

Lengths are summed over windows of ``WINDOW`` lines that bear text. A line that is mostly
links weighs nothing, unless it is a heading; a line inside an article weighs ``SURGE``
more. Where the sums surge, a stretch of main text begins; where they dive to nothing, it
ends; its lines are kept whole, short and linked ones too, so that a list of links falls out
of an article and a linked line between texts stays. A surge needs ``SURGE``
characters, or what the page's best stretch has; beside an article, what the
article's best window has.

A null or empty page has an empty text. Very long pages are read whole. Pages are judged one
by one, in one pass over their tags, so repeated rows give the same text; of stretches
that are alike all are kept. An empty table gives no rows. Other columns are not read,
whatever their names.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filegrain.llm.common import map_arrow

WINDOW, SURGE = 3, 80

# Elements by what they are for, and words in class or id that mark what is not main text.
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3"
    " h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split()
)
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
SPACES = set("br td th wbr img input".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
NOISE_TAGS = set(
    "nav header footer aside form menu dialog head title button select textarea iframe object svg canvas noscript template audio video".split()
)
NOISE_WORDS = set(
    "nav navbar navigation menu header masthead footer sidebar aside widget notice notices cookie cookies consent gdpr banner ad ads advert"
    " adverts advertisement advertising sponsor sponsored promo promotion newsletter subscribe subscription signup login form search share"
    " sharing social breadcrumb breadcrumbs pagination pager related recommended popup modal overlay comment comments disqus replies respond".split()
)
#: Those that an element of the page's own text may bear as well; the others are what their names say, whatever they hold.
WEAK_WORDS = set("header masthead footer sidebar aside widget notice notices banner promo promotion subscribe subscription signup login form search related recommended popup modal overlay".split())
COMMENT_WORDS = set("comment comments disqus replies respond".split())
#: Beside a noise word they tell of the page's state, as in has-sidebar.
STATE_WORDS = set("has no not with without open closed enabled disabled on off free hidden visible".split())
#: Elements that never are the page's text, whatever they hold; others are kept where they hold it.
NEVER_TEXT = NOISE_TAGS - {"form", "header", "dialog"}
WEAK_ROLES = set("banner form dialog alert alertdialog".split())
NOISE_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())

RAW = re.compile(r"(?is)<!--.*?(?:-->|\Z)|<(script|style|xmp|noembed|noframes)\b[^>]*>.*?(?:</\1\s*>|\Z)|<!\[CDATA\[|\]\]>|<[!?][^>]*>")
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?>"[^"<]*"|'[^'<]*'|[^>"'])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""")
NAMED = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORDS = re.compile(r"[^a-z0-9]+")
HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
HIDDEN_STYLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b")


NONE, WEAK, STRONG = range(3)


def noise(name: str, attributes: str, in_article: bool) -> int:
    """Whether an element is noise by its tag and attributes, and if so, whether it may hold the page's text after all."""
    if name in NOISE_TAGS:
        return STRONG if name in NEVER_TEXT else WEAK
    if name in ("html", "body", "main") or not attributes.strip():
        return NONE
    found = NONE
    for key, *values in NAMED.findall(attributes):
        key, value = key.lower(), "".join(values)
        if key in ("class", "id"):
            for token in value.split():
                words = set(WORDS.split(HUMP.sub("-", token).lower()))
                hit = words & (COMMENT_WORDS if name == "article" else NOISE_WORDS)
                if hit and not words & STATE_WORDS and not (in_article and hit == {"header"}):  # as in article-header: its title
                    found = max(found, WEAK if hit <= WEAK_WORDS else STRONG)
        elif key == "role":
            hit = set(WORDS.split(value.lower())) & NOISE_ROLES
            found = max(found, NONE if not hit else WEAK if hit <= WEAK_ROLES else STRONG)
        elif key == "hidden" or key == "aria-hidden" and value.strip().lower() == "true" or key == "style" and HIDDEN_STYLE.search(value.lower()):
            return STRONG
    return found


def holding_text(page: str, tags: list[tuple[int, int, bool, str, str]]) -> tuple[set[int], set[int]]:
    """Starts of the elements that hold all articles of the page, or without any, most of its text; starts of the articles."""
    open_: dict[str, list[int]] = {}
    ends = [len(tags)] * len(tags)
    for n, (_, _, closing, name, _) in enumerate(tags):
        if not closing:
            open_.setdefault(name, []).append(n)
        elif open_.get(name):
            ends[open_[name].pop()] = n
    counted, mass, own, at, strong = [0], [0], set(), 0, 0
    for n, (start, end, closing, name, attributes) in enumerate(tags):
        hidden = n < strong
        mass.append(mass[-1] + (0 if hidden else len(page[at:start].strip()) * (at <= start)))
        at = end
        kind = NONE if closing or hidden or name in VOID else noise(name, attributes, False)
        if kind == STRONG and ends[n] < len(tags):
            strong = ends[n]
        is_article = not closing and not hidden and kind == NONE and name in ("article", "main")
        counted.append(counted[-1] + is_article)
        if is_article:
            own.add(start)
    mass.append(mass[-1] + len(page[at:].strip()))
    held = set()
    for n, tag in enumerate(tags):
        if tag[2] or tag[3] in NEVER_TEXT or tag[3] in VOID:
            continue
        end = ends[n]
        if counted[-1]:
            if end < len(tags) and counted[end] - counted[n] == counted[-1]:
                held.add(tag[0])
        elif 2 * (mass[end + 1] - mass[n + 1]) > mass[-1]:
            held.add(tag[0])
    return held, own


def lines_of(page: str) -> list[tuple[str, int, bool]]:
    """(text, its weight: none if it is mostly links, inside an article) of each line."""
    page = RAW.sub(" ", page)
    tags = [(m.start(), m.end(), bool(m[1] or m[4]), (m[2] or m[5]).lower(), m[3] or m[6] or "") for m in TAG.finditer(page)]
    held, own = holding_text(page, tags)
    closings: dict[str, int] = {}
    for tag in tags:
        if tag[2]:
            closings[tag[3]] = closings.get(tag[3], 0) + 1
    lines: list[tuple[str, int, bool]] = []
    parts: list[str] = []
    linked = article = links = headings = at = 0
    inner: list[bool] = []  # of each article that is open, whether it is one of the page's
    skip: tuple[str, bool] | None = None  # the element that hides what follows, whether it can end
    depth = 0

    def end_line() -> None:
        nonlocal parts, linked
        text = " ".join(html.unescape("".join(parts)).split())
        lines.append((text, 0 if 5 * linked >= 3 * len(text) else len(text), article > 0))
        parts, linked = [], 0

    for start, end, closing, name, attributes in tags:
        if skip is None and start > at:
            parts.append(page[at:start])
            linked += (start - at) if links and not headings else 0
        at = end
        if closing:
            closings[name] -= 1
        if skip is not None:
            inside, closes = skip
            if closing and name == inside:
                depth -= 1
                if depth == 0:
                    skip = None
                    end_line()
            elif not closing and name == inside:
                depth += 1
            elif not closes and not closing and start in own:
                skip = None  # never closed: it ends where the article begins
            if name in BLOCKS:
                lines.append(("", 0, article > 0))
            if skip is not None or closing:
                continue
        kind = NONE if closing or name in VOID else noise(name, attributes, article > 0)
        if kind == STRONG or kind == WEAK and start not in held:
            end_line()
            skip, depth = (name, closings.get(name, 0) > 0), 1
            continue
        if name in BLOCKS:
            end_line()
        elif name in SPACES:
            parts.append(" ")
        if name == "article" or name == "main":
            if not closing:
                inner.append(start in own)
                article += inner[-1]
            elif inner:
                article -= inner.pop()
        elif name in HEADINGS:
            headings = 0 if closing else 1
        elif name == "a":
            links = max(0, links + (-1 if closing else 1))
    if skip is None:
        parts.append(page[at:])
    end_line()
    return lines


def main_text(page: str | None) -> str:
    if not page:
        return ""
    lines = [line for line in lines_of(page) if line[0]]
    lengths = [weight + (SURGE if weight and inside else 0) for _, weight, inside in lines]
    sums = [sum(lengths[max(0, i - WINDOW + 1) : i + 1]) for i in range(len(lengths) + WINDOW - 1)]
    stretches, at = [], 0
    for full, run in groupby(sums, key=lambda s: s > 0):
        run = list(run)
        if full:  # the window that ends a line later still holds it; the last line with text of its own ends the stretch
            end = min(at + len(run), len(lines))
            while not lengths[end - 1]:
                end -= 1
            stretches += by_article(lines, lengths, at, end)
        at += len(run)
    inside = max((peak for peak, _, _, own in stretches if own), default=0)
    surge = min(SURGE, max((peak for peak, *_ in stretches), default=0))
    kept = (text for peak, start, dive, own in stretches if peak >= (surge if own or not inside else max(surge, inside)) for text, *_ in lines[start:dive])
    return "\n\n".join(kept)


def by_article(lines: list[tuple[str, int, bool]], lengths: list[int], start: int, end: int) -> Iterator[tuple[int, int, int, bool]]:
    """(best window, start, end, inside an article) of the parts of a stretch inside and outside articles."""
    at = start
    for own, run in groupby(lines[start:end], key=lambda line: line[2]):
        stop = at + len(list(run))
        yield max(sum(lengths[max(at, i - WINDOW + 1) : i + 1]) for i in range(at, stop)), at, stop, own
        at = stop


def extract_text(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of each row."""
    kinds = {f.name: f.dataType.simpleString() for f in pages.select(key, url).schema}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(p) for p in batch[page].to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch[key], batch[url], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [key, url, "text", "n_chars"]
        )

    return map_arrow(pages.select(key, url, page), run, f"`{key}` {kinds[key]}, `{url}` {kinds[url]}, text string, n_chars long")


#: For pages laid out as the supplied ones: one article of headings and paragraphs, with bold parts and line
#: breaks, at times cut off. Tests hold pages of other kinds against what was planted in them.
SQL = r"""
WITH article AS (
  SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|<footer|\z)', 1), '<[^>]*$', '') AS a FROM pages),
blocks AS (
  SELECT page_id, url, list_filter(list_transform(
    string_split_regex(regexp_replace(replace(a, '<br>', ' '), '</?b>', '', 'g'), '</?(?:p|h1)>'),
    lambda x: trim(regexp_replace(regexp_replace(replace(replace(replace(x, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))),
    lambda x: x <> '') AS b FROM article),
texts AS (SELECT page_id, url, coalesce(array_to_string(b, chr(10) || chr(10)), '') AS text FROM blocks)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM texts
"""


#: Around a document's lines, by layout: what precedes the first line, a line's begin and end, what follows the last one.
LAYOUTS = (
    ("<body><div id='top-menu'><a href='/'>Home</a> <a href='/n'>News</a></div><div class='post has-sidebar'>", "<p>", "</p>",
     "</div><div id='comments'><article class='comment-body'><p>The first comment of a reader, who goes on and on about what the text says.</p></article></div></body>"),
    ("<body><div class='navColumn'><p>All sections of the site</p></div><table>", "<tr><td>", "</td></tr>",
     "</table><div class='google_ads'><div>Buy two and pay for one, today only</div></div><div class='cookieConsent'>We use cookies, and so do others</div></body>"),
    ("<body><main><div><a href='/'>Home</a> | <a href='/n'>News</a> | <a href='/s'>Sport</a></div>", "<section><div>", "</div></section>",
     "<ul><li><a href='/t'>Tweet</a><li><a href='/m'>Mail</a><li><a href='/p'>Print</a></ul></main><div class='comments-area'>Well said.</div></body>"),
    ("<body><ul><li><a href='/a'>A</a><li><a href='/b'>B</a></ul><div><div class=ad-slot>Advert</div>", "<h2>", "</h2>",
     "<div class='reader-comments'><div>Not so.</div></div></div><div><a href='/x'>Next</a></div><footer>Imprint</footer></body>"),
)


def laid_out(docs: DataFrame) -> DataFrame:
    """(page_id, url, html): each document's lines in one of LAYOUTS, with character references."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.length(F.trim(x)) > 0)
    escaped = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&#62;"))
    part = lambda k: F.element_at(F.array(*[F.lit(x[k]) for x in LAYOUTS]), (F.pmod("doc_id", F.lit(len(LAYOUTS))) + 1).cast("int"))
    body = F.array_join(F.transform(lines, lambda x: F.concat(part(1), escaped(x), part(2))), "")
    return docs.select(F.col("doc_id").alias("page_id"), F.lit("").alias("url"), F.concat(part(0), body, part(3)).alias("html"))


LAYOUT_SQL = r"""
WITH lines AS (
  SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(x, '[\s\x0B\x1C-\x1F\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'))), lambda x: x <> '') AS b
  FROM documents),
texts AS (SELECT doc_id, array_to_string(b, chr(10) || chr(10)) AS text FROM lines)
SELECT doc_id AS page_id, '' AS url, text, CAST(length(text) AS BIGINT) AS n_chars FROM texts
"""
