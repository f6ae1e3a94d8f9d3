"""Near-duplicate vectors on a robust-pruned flat graph.

Cluster centres are fitted on a bounded sample. Every vector belongs to the shards of
its ``PLACES`` nearest centres; shards over ``SHARD_ROWS`` are cut into blocks. In each
block a graph is built: a member's candidates are its nearest members and some drawn
ones, and robust pruning keeps those that no kept one is much closer to. A member's
lists from its shards are united. Then every vector is searched in the shards of its
nearest centres: best first from the medoid, the pivots and its own node, then onward
through all nodes within range, as long as that finds more. What is found counts only
when its cosine in double precision reaches the threshold.

How many centres are searched is measured, as it grows with their number: partners at
the threshold, in drawn directions, are planted beside rows that the centres were not
fitted on, and as many are searched as let ``ENOUGH`` of these links meet in a shard,
``LEAST_PROBES`` at least. With all centres searched every link meets.

Vectors that are null, empty, zero, or hold null or non-finite components link with
nothing; vectors of different lengths do not link. Equal vectors are one node with a
multiplicity. Rows that repeat an id are one vector for the components; each row is
returned. ``recall_audit`` compares the links of every hundredth id with brute force.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filegrain.llm.common import map_arrow, unit_hash, written
from filegrain.llm.components import connected
from filegrain.session import ship_package

LEAST_COSINE = 0.9
ROWS_PER_CENTRE, MOST_CENTRES, SAMPLED_PER_CENTRE = 1000, 16384, 16
SHARD_ROWS, QUERY_ROWS = 4096, 4096
PLACES, LEAST_PROBES = 2, 3
ENOUGH, PLANTED = 0.97, 4000
NEAREST, DRAWN, NEAR_EDGES, FAR_EDGES, SLACK = 48, 24, 20, 8, 1.2
PIVOTS, GREEDY_STEPS, RANGE_SLACK = 16, 24, 0.08
SEED = 11


def unit_rows(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as unit rows in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_centres(x: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means in single precision."""
    rng = np.random.default_rng(SEED)
    x = x.astype(np.float32)
    centres = x[rng.choice(len(x), min(count, len(x)), replace=False)]
    for _ in range(rounds):
        of = np.concatenate([(x[at : at + 2048] @ centres.T).argmax(1) for at in range(0, len(x), 2048)])
        sums = np.zeros_like(centres)
        np.add.at(sums, of, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 1e-6, sums / np.maximum(norm, 1e-6), centres)
    return centres


def probes_needed(centres: np.ndarray, x: np.ndarray, least: float) -> np.ndarray:
    """For each row, how many nearest centres must be searched for its link with a planted partner to meet in a shard."""
    rng = np.random.default_rng(SEED)
    needed = []
    for at in range(0, len(x), 256):
        a = x[at : at + 256]
        aside = rng.normal(size=a.shape)
        aside -= np.einsum("rd,rd->r", aside, a)[:, None] * a
        aside /= np.maximum(np.linalg.norm(aside, axis=1, keepdims=True), 1e-12)
        b = least * a + np.sqrt(max(0.0, 1 - least * least)) * aside
        near = [v.astype(np.float32) @ centres.T for v in (a, b)]
        places = [np.argsort(-n, axis=1, kind="stable")[:, :PLACES] for n in near]
        ranks = [(n[:, None, :] > np.take_along_axis(n, p, 1)[:, :, None]).sum(2).min(1) for n, p in zip(near, places[::-1])]
        needed.append(np.minimum(*ranks) + 1)
    return np.concatenate(needed)


def _places(centres: np.ndarray, probes: int, batch: pa.RecordBatch) -> pa.RecordBatch:
    x = unit_rows(batch["embedding"]).astype(np.float32)
    order = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :probes]
    rank = np.tile(np.arange(order.shape[1]), len(x))
    take = pa.array(np.repeat(np.arange(len(x)), order.shape[1]))
    return pa.RecordBatch.from_arrays(
        [pa.array(order.ravel().astype(np.int32)), batch["id"].take(take), pa.array(rank < PLACES), batch["embedding"].take(take)], ["shard", "id", "member", "embedding"]
    )


def prune(x: np.ndarray, candidates: np.ndarray, edges: int) -> np.ndarray:
    """Robust pruning of each row's candidates (-1: none), nearest first; -1 where fewer are kept."""
    kept = np.full((len(candidates), edges), -1, dtype=np.int64)
    for at in range(0, len(candidates), 256):
        c = candidates[at : at + 256]
        own = x[at : at + 256]
        points = x[np.maximum(c, 0)]
        far = 1 - np.einsum("rd,rcd->rc", own, points)
        alive = (c >= 0) & (c != np.arange(at, at + len(c))[:, None])
        rows = np.arange(len(c))
        for k in range(edges):
            best = np.where(alive, far, np.inf).argmin(1)
            some = alive[rows, best]
            if not some.any():
                break
            kept[at : at + 256, k] = np.where(some, c[rows, best], -1)
            between = 1 - np.einsum("rd,rcd->rc", points[rows, best], points)
            alive &= ~((SLACK * between <= far) & some[:, None])
            alive[rows, best] = False
    return kept


def build_graph(x: np.ndarray) -> np.ndarray:
    """Neighbours of each row, padded with -1; edges run both ways as far as there is room."""
    n = len(x)
    rng = np.random.default_rng(SEED)
    near = np.concatenate([np.argpartition(-(x[at : at + 512] @ x.T), min(NEAREST, n - 1), axis=1)[:, : NEAREST + 1] for at in range(0, n, 512)])
    lists = np.concatenate([prune(x, near, NEAR_EDGES), prune(x, rng.integers(0, n, (n, DRAWN)), FAR_EDGES)], 1)
    a, b = np.repeat(np.arange(n), lists.shape[1]), lists.ravel()
    a, b = a[b >= 0], b[b >= 0]
    return padded(np.concatenate([a, b]), np.concatenate([b, a]), n)


def padded(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Edge list to rows of neighbours."""
    pairs = np.unique(a * n + b)
    a, b = pairs // n, pairs % n
    count = np.bincount(a, minlength=n)
    out = np.full((n, max(1, count.max(initial=0))), -1, dtype=np.int64)
    out[a, np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count)] = b
    return out


def _build(unit: pa.Table) -> pa.Table:
    ids = unit["id"].to_numpy()
    graph = build_graph(unit_rows(unit["embedding"]).astype(np.float32))
    return pa.table({"id": pa.array(ids, pa.int64()), "near": pa.array([ids[row[row >= 0]] for row in graph], pa.list_(pa.int64()))})


def search(x: np.ndarray, graph: np.ndarray, q: np.ndarray, own: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(row of q, row of x) of what is found with a cosine of about ``least`` or more. ``own``: q's own row in x, or -1."""
    n, rows = len(x), np.arange(len(q))
    centre = x.mean(0)
    pivots = [int((x @ centre).argmax())]
    covered = x @ x[pivots[0]]
    for _ in range(min(PIVOTS, n) - 1):
        pivots.append(int(covered.argmin()))
        covered = np.maximum(covered, x @ x[pivots[-1]])
    seen = np.full((len(q), n), -2, dtype=np.float32)  # cosine once visited
    open_ = np.full((len(q), n), -2, dtype=np.float32)  # the same while not expanded

    def visit(r: np.ndarray, c: np.ndarray) -> None:
        fresh = seen[r, c] == -2
        r, c = r[fresh], c[fresh]
        for at in range(0, len(r), 1 << 17):
            i, j = r[at : at + (1 << 17)], c[at : at + (1 << 17)]
            seen[i, j] = open_[i, j] = np.einsum("kd,kd->k", q[i], x[j])

    def expand(r: np.ndarray, c: np.ndarray) -> None:
        open_[r, c] = -2
        for at in range(0, len(r), 1 << 15):
            near = graph[c[at : at + (1 << 15)]]
            pairs = np.unique((r[at : at + (1 << 15), None] * n + near)[near >= 0])
            visit(pairs // n, pairs % n)

    for p in set(pivots):
        visit(rows, np.full(len(q), p))
    visit(rows[own >= 0], own[own >= 0])
    for _ in range(GREEDY_STEPS):
        best = open_.argmax(1)
        going = open_[rows, best] > -2
        if not going.any():
            break
        expand(rows[going], best[going])
    while True:
        r, c = np.nonzero(open_ >= least - RANGE_SLACK)
        if not len(r):
            break
        expand(r, c)
    return np.nonzero(seen >= least - 1e-4)


def _search(least: float, unit: pa.Table) -> pa.Table:
    member, query = unit["member"].to_numpy(zero_copy_only=False), unit["query"].to_numpy(zero_copy_only=False)
    ids, vectors = unit["id"].to_numpy(), unit_rows(unit["embedding"])
    m, k = np.flatnonzero(member), np.flatnonzero(query)
    none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    if not len(m) or not len(k):
        return none
    m = m[np.unique(ids[m], return_index=True)[1]]  # sorted by id
    names = ids[m]
    lists = unit["near"].combine_chunks().take(pa.array(m))
    a = np.repeat(np.arange(len(m)), np.diff(lists.offsets.to_numpy()))
    b = lists.flatten().to_numpy()
    at = np.minimum(np.searchsorted(names, b), len(names) - 1)
    here = names[at] == b
    graph = padded(a[here], at[here], len(m))
    own = np.minimum(np.searchsorted(names, ids[k]), len(names) - 1)
    own = np.where(names[own] == ids[k], own, -1)
    r, c = search(vectors[m].astype(np.float32), graph, vectors[k].astype(np.float32), own, least)
    exact = np.concatenate([np.einsum("kd,kd->k", vectors[k[r[i : i + 65536]]], vectors[m[c[i : i + 65536]]]) for i in range(0, len(r), 65536)] or [np.zeros(0)])
    left, right = ids[k[r]], names[c]
    good = (exact >= least) & (left != right)
    pairs = np.unique(np.stack([np.maximum(left, right)[good], np.minimum(left, right)[good]], 1), axis=0)
    return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})


def usable(embedding: F.Column) -> F.Column:
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return F.coalesce((F.size(embedding) > 0) & ~F.exists(embedding, bad) & F.exists(embedding, lambda v: v != 0), F.lit(False))


def links_of(nodes: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """Distinct (a, b), a > b, of nodes (id, embedding) of one vector length."""
    count, kind = nodes.count(), nodes.schema["embedding"].dataType.simpleString()
    centres_wanted = min(MOST_CENTRES, max(1, -(-count // ROWS_PER_CENTRE)))
    share = min(1.0, centres_wanted * SAMPLED_PER_CENTRE / max(count, 1))
    drawn = nodes.where(unit_hash(F.col("id"), SEED) < share).orderBy("id").select("embedding").toArrow()
    if not len(drawn):
        drawn = nodes.orderBy("id").limit(1).select("embedding").toArrow()
    centres = fit_centres(unit_rows(drawn["embedding"]), centres_wanted)
    probes = LEAST_PROBES
    if len(centres) > probes:
        others = unit_hash(F.col("id"), SEED).between(share, share + PLANTED / count)
        beside = nodes.where(others).orderBy("id").select("embedding").toArrow()
        needed = probes_needed(centres, unit_rows((beside if len(beside) else drawn)["embedding"]), least)
        probes = max(probes, int(np.quantile(needed, ENOUGH, method="higher")))
    placed = written(map_arrow(nodes.select("id", "embedding"), partial(_places, centres, probes), f"shard int, id long, member boolean, embedding {kind}"), "vectors-places")
    sizes = placed.groupBy("shard").agg(
        F.greatest(F.ceil(F.count_if("member") / SHARD_ROWS), F.lit(1)).cast("int").alias("blocks"),
        F.greatest(F.ceil(F.count(F.lit(1)) / QUERY_ROWS), F.lit(1)).cast("int").alias("sets"),
    )
    dealt = placed.join(F.broadcast(sizes), "shard").withColumns({  # one row for each centre
        "block": F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"), "set": F.pmod(F.xxhash64("id", F.lit(1)), F.col("sets")).cast("int"),
    })
    built = dealt.where("member").select("shard", "block", "id", "embedding").groupBy("shard", "block").applyInArrow(_build, "id long, near array<bigint>")
    graph = written(built.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "vectors-graph")
    members = dealt.where("member").join(graph, "id").select("shard", "block", F.explode(F.sequence(F.lit(0), F.col("sets") - 1)).alias("set"), "id", F.lit(True).alias("member"), F.lit(False).alias("query"), "embedding", "near")
    queries = dealt.select("shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "set", "id", F.lit(False).alias("member"), F.lit(True).alias("query"), "embedding", F.lit(None).cast("array<bigint>").alias("near"))
    return members.unionByName(queries).groupBy("shard", "block", "set").applyInArrow(lambda unit: _search(least, unit), "a long, b long").distinct()


def components_kept(embeddings: DataFrame, vector: str) -> F.Column:
    """The vectors as they are compared: single precision stays so, as doubles hold it exactly; all else is double."""
    single = embeddings.schema[vector].dataType.simpleString() == "array<float>"
    return F.col(vector).cast("array<float>" if single else "array<double>")


def near_vectors(embeddings: DataFrame, least: float = LEAST_COSINE, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, n_links, component_id, kept) of each row."""
    ship_package()
    rows = embeddings.select(F.col(key).cast("long").alias("id"), components_kept(embeddings, vector).alias("embedding"))
    rows = rows.withColumn("good", usable(F.col("embedding")) & F.col("id").isNotNull())
    nodes = written(
        rows.where("good").groupBy("embedding").agg(F.min("id").alias("id"), F.count_distinct("id").alias("copies")).withColumn("length", F.size("embedding")), "vectors-nodes"
    )
    lengths = [r[0] for r in nodes.select("length").distinct().orderBy("length").collect()]
    links = rows.sparkSession.createDataFrame([], "a long, b long")
    for length in lengths:
        links = links.unionByName(links_of(nodes.where(F.col("length") == length), least))
    links = written(links, "vectors-links")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    copies = nodes.select(F.col("id").alias("b"), "copies")
    degrees = both.join(copies, "b").groupBy("a").agg(F.sum("copies").alias("others"))
    joined = connected(links, "vectors-components")
    named = nodes.join(degrees, nodes["id"] == degrees["a"], "left").join(joined.withColumnRenamed("id", "of"), nodes["id"] == F.col("of"), "left").select(
        nodes["embedding"].alias("of_embedding"), (nodes["copies"] - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", nodes["id"]).alias("component_id")
    )
    keyed = rows.withColumn("of_row", F.when(F.col("good"), F.col("embedding")))
    n_links, component = F.coalesce("n_links", F.lit(0)).cast("long"), F.coalesce("component_id", "id")
    return keyed.join(named, keyed["of_row"] == named["of_embedding"], "left").select(
        F.col("id").alias(key), n_links.alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept")
    )


def _brute(least: float, unit: pa.Table) -> pa.Table:
    query = unit["query"].to_numpy(zero_copy_only=False)
    ids, x = unit["id"].to_numpy(), unit_rows(unit["embedding"])
    k, m = np.flatnonzero(query), np.flatnonzero(~query)
    r, c = np.nonzero(x[k] @ x[m].T >= least)
    a, b = ids[k[r]], ids[m[c]]
    return pa.table({"a": pa.array(a[a != b], pa.int64()), "b": pa.array(b[a != b], pa.int64())})


def recall_audit(embeddings: DataFrame, least: float = LEAST_COSINE, every: int = 100, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(queries, true_links, found, recall): number of links of the ids divisible by ``every`` by brute force and by the graph.

    Queries and all rows are dealt into blocks; every block of queries meets every block of rows.
    """
    rows = embeddings.select(F.col(key).cast("long").alias("id"), components_kept(embeddings, vector).alias("embedding"))
    rows = rows.where(usable(F.col("embedding")) & F.col("id").isNotNull()).withColumn("length", F.size("embedding"))
    asked = rows.where(F.col("id") % every == 0)
    sets, blocks = max(1, -(-asked.count() // QUERY_ROWS)), max(1, -(-rows.count() // SHARD_ROWS))
    deal = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")
    every_one = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("length", deal(sets, 1).alias("set"), every_one(blocks).alias("block"), "id", F.lit(True).alias("query"), "embedding")
    right = rows.select("length", every_one(sets).alias("set"), deal(blocks, 2).alias("block"), "id", F.lit(False).alias("query"), "embedding")
    true = left.unionByName(right).groupBy("length", "set", "block").applyInArrow(lambda unit: _brute(least, unit), "a long, b long").groupBy("a").agg(F.count_distinct("b").alias("n"))
    found = near_vectors(embeddings, least, key, vector).dropDuplicates([key])
    both = asked.select("id").distinct().join(true, F.col("id") == F.col("a"), "left").join(found, F.col("id") == F.col(key), "left")
    sums = both.agg(F.count(F.lit(1)).alias("queries"), F.coalesce(F.sum("n"), F.lit(0)).alias("true_links"), F.coalesce(F.sum("n_links"), F.lit(0)).alias("found"))
    return sums.withColumn("recall", F.when(F.col("true_links") > 0, F.col("found") / F.col("true_links")).otherwise(F.lit(1.0)))


#: By comparing all with all: for the small tables that the queries are checked on.
SQL = f"""
WITH RECURSIVE good AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {LEAST_COSINE}),
degree AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY 1),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
component AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM component LEFT JOIN degree USING (vec_id)
"""
