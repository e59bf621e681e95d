"""Approximate nearest neighbours by largest cosine with robust-pruned directed graphs.

Equal vectors form one class with its smallest ids; classes are dealt to shards by hash,
each of about ``SHARD_ROWS``.  In every shard a directed graph is built: vectors are
inserted in a seeded order; a greedy beam search from the medoid proposes neighbours, and
relaxed pruning keeps a candidate only if no kept neighbour is ``ALPHA`` times closer to
it than the inserted vector is, which leaves short and long, diverse edges.  Back edges
are added, and pruned alike where a list overflows.  The index is a table of all shards'
vectors and edges.  Every query runs a beam search in every shard; the best of all
shards, scored in double precision on the original vectors, are merged.

A shard's group is bounded by ``SHARD_ROWS`` and a block of queries by ``QUERY_BLOCK``,
whatever the number of copies of one vector.

Defined results: vectors null, empty, zero or with null or non-finite components take no
part; vectors of another length are no candidates; rows equal in id and vector are one; a
query has no row of its own id as a candidate; equal scores stand by id; fewer than k
candidates give fewer rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.common import materialise

SHARD_ROWS, QUERY_BLOCK = 4096, 4096
DEGREE, BUILD_BEAM, ALPHA, SEARCH_BEAM, WIDTH, BATCH = 24, 48, 1.2, 192, 4, 256


# ---------------------------------------------------------------- graph (numpy)


def beam_search(x: np.ndarray, edges: np.ndarray, entry: int, q: np.ndarray, beam: int) -> np.ndarray:
    """The ``beam`` best nodes found for each unit query, nearest first (-1: none)."""
    b, n = len(q), len(x)
    seen = np.zeros((b, n + 1), bool)
    seen[:, n] = True  # the place of missing edges
    seen[:, entry] = True
    ids, sim = np.full((b, beam), n), np.full((b, beam), -np.inf, np.float32)
    ids[:, 0], sim[:, 0] = entry, q @ x[entry]
    open_ = np.zeros((b, beam), bool)
    open_[:, 0] = True
    rows = np.arange(b)[:, None]
    while open_.any():
        pick = np.argsort(~open_, axis=1, kind="stable")[:, :WIDTH]  # the nearest not yet expanded
        live = np.take_along_axis(open_, pick, 1)
        np.put_along_axis(open_, pick, False, 1)
        new = np.where(live[:, :, None], edges[np.minimum(np.take_along_axis(ids, pick, 1), n - 1)], n).reshape(b, -1)
        new = np.sort(np.where(new < 0, n, new), 1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = n
        new = np.where(seen[rows, new], n, new)
        keep = np.sort(new, 1)[:, : max(1, int((new < n).sum(1).max()))]
        seen[rows, keep] = True
        s = np.einsum("bd,bkd->bk", q, x[np.minimum(keep, n - 1)])
        s[keep == n] = -np.inf
        ids, sim = np.concatenate([ids, keep], 1), np.concatenate([sim, s], 1)
        open_ = np.concatenate([open_, keep < n], 1)
        top = np.argsort(-sim, axis=1, kind="stable")[:, :beam]
        ids, sim, open_ = (np.take_along_axis(a, top, 1) for a in (ids, sim, open_))
    return np.where(ids == n, -1, ids)


def prune(x: np.ndarray, own: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Diverse neighbours of each ``own`` node among its candidates (-1: none)."""
    cand = np.sort(cand, 1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
    bad = (cand < 0) | (cand == own[:, None])
    v = x[np.maximum(cand, 0)]
    far = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("bd,bkd->bk", x[own], v)))
    far[bad] = np.inf
    order = np.argsort(far, 1, kind="stable")
    cand, far, v = np.take_along_axis(cand, order, 1), np.take_along_axis(far, order, 1), np.take_along_axis(v, order[:, :, None], 1)
    between = np.sqrt(np.maximum(0, 2 - 2 * (v @ v.transpose(0, 2, 1))))
    out = np.full((len(own), degree), -1)
    rows = np.arange(len(own))
    alive = np.isfinite(far)
    for k in range(degree):
        first = alive.argmax(1)
        some = alive[rows, first]
        if not some.any():
            break
        out[some, k] = cand[rows, first][some]
        alive &= alpha * between[rows, first] > far
        alive[rows, first] = False
    return out


def build(x: np.ndarray, seed: int = 0, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """Edges (n, degree) of the graph over unit vectors, and the entry node."""
    n = len(x)
    rng = np.random.default_rng(seed)
    entry = int((x @ x.mean(0)).argmax())
    edges = rng.integers(0, n, (n, degree // 2)) if n > 1 else np.zeros((n, degree // 2), int)
    edges = np.concatenate([edges, np.full((n, degree - degree // 2), -1)], 1)
    order = rng.permutation(n)
    for lo in range(0, n, BATCH):
        own = order[lo : lo + BATCH]
        found = beam_search(x, edges, entry, x[own], min(beam, n))
        edges[own] = prune(x, own, np.concatenate([found, edges[own]], 1), degree, alpha)
        src = np.repeat(own, degree)
        dst = edges[own].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        by = np.argsort(dst, kind="stable")
        src, dst = src[by], dst[by]
        nth = np.arange(len(dst)) - np.searchsorted(dst, dst)
        for part in range(int(nth.max()) // degree + 1 if len(nth) else 0):  # back edges, ``degree`` at a time
            sel = nth // degree == part
            node, at = np.unique(dst[sel], return_inverse=True)
            more = np.full((len(node), degree), -1)
            more[at, nth[sel] % degree] = src[sel]
            both = np.concatenate([edges[node], more], 1)
            both.sort(1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            full = (both >= 0).sum(1) > degree
            if full.any():
                edges[node[full]] = prune(x, node[full], both[full], degree, alpha)
            edges[node[~full]] = -np.sort(-both[~full], 1)[:, :degree]
    return edges, entry


# ------------------------------------------------------------------ Spark side


def usable(vec: Column) -> Column:
    """No null or non-finite component, and not zero (a null vector: false)."""
    bad = F.exists(vec, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(~bad & F.exists(vec, lambda v: v != 0), F.lit(False))


def with_class(vectors: DataFrame) -> DataFrame:
    """vec_id, vec (double), cls (name of the vector: rows of equal vectors share it)."""
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vec")).filter(F.col("vec_id").isNotNull() & usable(F.col("vec")))
    v = v.withColumn("vec", F.transform("vec", lambda c: c + F.lit(0.0)))  # -0.0 is 0.0
    return v.withColumn("cls", F.concat(F.hex(F.xxhash64("vec")), F.lit("-"), F.hex(F.xxhash64(F.lit(1), F.reverse("vec")))))


def _unit(vecs: np.ndarray) -> np.ndarray:
    big = np.abs(vecs).max(1, keepdims=True)
    v = vecs / big
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def _scaled(vecs: np.ndarray) -> np.ndarray:
    """Vectors times a power of two each (exact), so that no square overflows or vanishes."""
    return np.ldexp(vecs, -np.frexp(np.abs(vecs).max(1))[1][:, None])


def index(classes: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """dim, shard, node, cls, vec, edges, entry of every class: one graph per shard."""
    sizes = classes.groupBy(F.size("vec").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    sizes = materialise(sizes.select("dim", F.ceil(F.col("n") / shard_rows).cast("int").alias("shards")), "ann-sizes")
    dealt = classes.withColumn("dim", F.size("vec")).join(sizes, "dim").withColumn("shard", F.pmod(F.xxhash64("cls"), F.col("shards")).cast("int"))

    def graph(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("cls", ignore_index=True)
        edges, entry = build(_unit(np.stack(rows["vec"].to_numpy())))
        return rows.assign(node=np.arange(len(rows)), edges=[e[e >= 0] for e in edges], entry=entry)[["dim", "shard", "node", "cls", "vec", "edges", "entry"]]

    schema = "dim int, shard int, node int, cls string, vec array<double>, edges array<int>, entry int"
    return materialise(dealt.select("dim", "shard", "cls", "vec").groupBy("dim", "shard").applyInPandas(graph, schema), "ann-index")


def search(index_rows: DataFrame, queries: DataFrame, k: int, beam: int = SEARCH_BEAM) -> DataFrame:
    """q, cls, score: of every shard the ``k`` best classes found for each query class."""
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    shards = materialise(index_rows.select("dim", "shard").distinct(), "ann-shards")
    dealt = queries.select(F.col("cls").alias("q"), F.col("vec").alias("qvec"), F.size("vec").alias("dim"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int")).join(shards, "dim")
    spread = index_rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def best(graph: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"q": [], "cls": [], "score": []})
        if not len(graph) or not len(ask):
            return empty
        graph = graph.sort_values("node", ignore_index=True)
        vecs, qs = np.stack(graph["vec"].to_numpy()), np.stack(ask["qvec"].to_numpy())
        edges = np.full((len(graph), DEGREE), -1)
        for i, e in enumerate(graph["edges"]):
            edges[i, : len(e)] = e
        x, q = _unit(vecs), _unit(qs)
        vecs, qs = _scaled(vecs), _scaled(qs)
        norm = np.sqrt((vecs * vecs).sum(1))
        out = []
        for lo in range(0, len(q), BATCH):
            ids = beam_search(x, edges, int(graph["entry"][0]), q[lo : lo + BATCH], max(beam, k))
            own = qs[lo : lo + BATCH]
            real = np.maximum(ids, 0)
            score = np.einsum("bd,bkd->bk", own, vecs[real]) / (np.sqrt((own * own).sum(1))[:, None] * norm[real])
            score[ids < 0] = -np.inf
            top = np.argsort(-score, 1, kind="stable")[:, :k]
            b, c = np.nonzero(np.isfinite(np.take_along_axis(score, top, 1)))
            at = top[b, c]
            out.append(pd.DataFrame({"q": ask["q"].to_numpy()[lo + b], "cls": graph["cls"].to_numpy()[ids[b, at]], "score": score[b, at]}))
        return pd.concat(out, ignore_index=True)

    keys = ["dim", "shard", "block"]
    return spread.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInPandas(best, "q string, cls string, score double")


def nearest(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` nearest rows found for every query row of
    ``vectors`` (vec_id, embedding)."""
    rows = materialise(with_class(vectors), "ann-rows")
    classes = materialise(rows.groupBy("cls").agg(F.first("vec").alias("vec")), "ann-classes")
    ids = rows.select("cls", "vec_id").distinct()
    smallest = ids.withColumn("nth", F.row_number().over(Window.partitionBy("cls").orderBy("vec_id"))).filter(F.col("nth") <= k + 1).drop("nth")
    smallest = materialise(smallest, "ann-ids")
    asked = materialise(ids.filter(is_query).select("vec_id", "cls"), "ann-asked")
    queries = asked.select("cls").distinct().join(classes, "cls")
    found = materialise(search(index(classes), queries, k + 1), "ann-found")
    # the k + 1 best rows of each query class; a query then leaves out its own id
    rows_of = found.join(smallest, "cls").select("q", "vec_id", "score")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    rows_of = rows_of.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= k + 1)
    rows_of = materialise(rows_of.select("q", F.col("vec_id").alias("found"), "score"), "ann-best")
    pairs = asked.join(rows_of, asked["cls"] == rows_of["q"]).filter(F.col("found") != F.col("vec_id"))
    nth = F.row_number().over(Window.partitionBy("vec_id", "cls").orderBy(F.desc("score"), "found"))
    pairs = pairs.withColumn("rank", nth.cast("int")).filter(F.col("rank") <= k)
    return pairs.select(F.col("vec_id").alias("query_id"), "rank", F.col("found").alias("vec_id"), "score")
