"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints: lower-case A-Z, words ``[^\\x20\\x09-\\x0D]+``, word shingles with repeats
(a shorter text is one shingle), XXH64 of each; a bit is set if it is set in over half of
the hashes.  Null text or text without a word: fingerprint zero, linked like any other.

Search of all pairs within ``max_bits``, on distinct fingerprints only:

1. counts of every bit and bit pair over all fingerprints give bit correlations; bits
   that go together are grouped into one partition, so that partitions are as
   independent of each other as the data allow;
2. if a pair differs in at most t bits, then for any integer thresholds with
   ``sum(T) = t - m + 1`` it differs in at most ``T[i]`` bits of some partition i (a
   threshold of -1 leaves a partition out).  Candidates of a partition at a threshold
   are estimated from the counts of its values and of its bits; a dynamic program picks
   the thresholds, and the number of partitions, with the least estimated work;
3. every fingerprint is sent to the value of each partition, and to the values within
   the partition's threshold of it; equal values meet in one bucket.  Buckets beyond
   ``BLOCK`` rows are dealt out as pairs of blocks, so no bucket is one task's work;
4. each bucket compares its fingerprints on all bits.  It returns a spanning star of
   each linked set instead of all links: connectivity is kept, output stays linear;
5. components of the links by alternating large-star and small-star steps.

No candidate, bucket or component is capped.  Rows with a null id take part; a component
without any id has a null ``component_id``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import materialise, unused

SHINGLE, MAX_BITS, SEED, BLOCK = 3, 3, 42, 1024
#: Relative cost of one routed row and one compared pair, for the choice of partitions.
ROW_COST, PAIR_COST = 1.0, 0.002


# --------------------------------------------------------------- fingerprints


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit value of the text's fingerprint."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    size = np.array([len(w) + 1 for w in words])
    end = np.cumsum(size) - 1
    start = end - size + 1
    k = min(shingle, len(words))
    spans = zip(start[: len(words) - k + 1].tolist(), end[k - 1 :].tolist(), strict=True)
    h = np.array([xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in spans], np.uint64)
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(h), 1 << 14):
        part = h[lo : lo + (1 << 14)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<i8")[0])


def fingerprint_udf(shingle: int = SHINGLE):
    @F.pandas_udf("long")
    def fp(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([fingerprint(t if isinstance(t, str) else None, shingle) for t in s], dtype="int64")

    return fp


# ----------------------------------------------------------- partitions of bits


def _bit_counts(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and how often each pair of bits is set together (64 x 64),
    summed over all fingerprints; what reaches the driver is 4,096 numbers."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((64, 64))
        n = 0
        for b in batches:
            f = b["fp"].to_numpy(np.int64)
            for lo in range(0, len(f), 1 << 15):
                bits = np.unpackbits(f[lo : lo + (1 << 15)].astype("<i8").view(np.uint8), bitorder="little")
                bits = bits.reshape(-1, 64).astype(np.float32)
                total += bits.T @ bits
            n += len(f)
        if n:
            cell = np.append(total.ravel(), n).astype(np.int64)
            yield pd.DataFrame({"cell": np.arange(4097), "c": cell})

    rows = nodes.select("fp").mapInPandas(partial, "cell int, c long").groupBy("cell").agg(F.sum("c").alias("c")).collect()
    flat = np.zeros(4097)
    for r in rows:
        flat[r["cell"]] = r["c"]
    return int(flat[4096]), flat[:4096].reshape(64, 64)


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """``m`` groups of bits of nearly equal size, each grown by the bit that correlates
    most with the group so far."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, groups = set(range(64)), []
    for g in range(m):
        size = (64 - sum(map(len, groups))) // (m - g)
        seed = max(free, key=lambda b: (corr[b, sorted(free)].sum(), -b))
        group = [seed]
        free.remove(seed)
        while len(group) < size:
            nxt = max(free, key=lambda b: (corr[b, group].sum(), -b))
            group.append(nxt)
            free.remove(nxt)
        groups.append(sorted(group))
    return groups


def mask_of(bits: list[int]) -> int:
    """Signed 64-bit mask."""
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >= 1 << 63 else m


def within(p_differ: np.ndarray, t: int) -> np.ndarray:
    """P(at most 0..t of the bits differ) for independent bits."""
    dist = np.zeros(t + 1)
    dist[0] = 1.0
    for q in p_differ:
        dist[1:] = dist[1:] * (1 - q) + dist[:-1] * q
        dist[0] *= 1 - q
    return np.cumsum(dist)


def allocate(cost: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds (each -1, 0, ...) of least summed cost with the given sum, by dynamic
    programming over the partitions; ``cost[i][t + 1]`` is partition i's cost at t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in cost:
        new: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for k, extra in enumerate(row):
                at = s + k - 1
                if at not in new or c + extra < new[at][0]:
                    new[at] = (c + extra, [*ts, k - 1])
        best = new
    return best[total]


def _masks(bits: list[int], t: int) -> list[int]:
    """XOR masks of all flips of at most ``t`` of the bits, the empty one first."""
    out, last = [()], [()]
    for _ in range(t):
        last = [(*c, b) for c in last for b in bits if not c or b > c[-1]]
        out += last
    return [mask_of(list(c)) for c in out]


def _pairs_in_values(nodes: DataFrame, groups: list[list[int]]) -> list[float]:
    """For each group of bits, the number of fingerprint pairs with equal bits there."""
    parts = [F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(mask_of(g))).alias("v")) for i, g in enumerate(groups)]
    counts = nodes.select(F.explode(F.array(*parts)).alias("k")).groupBy("k").count()
    rows = counts.groupBy("k.i").agg(F.sum(F.col("count") * (F.col("count") - 1.0) / 2).alias("pairs")).collect()
    got = {r["i"]: r["pairs"] for r in rows}
    return [float(got.get(i, 0.0)) for i in range(len(groups))]


def choose_partitions(nodes: DataFrame, max_bits: int) -> list[tuple[list[int], int]]:
    """The bit groups and their thresholds with the least estimated work."""
    n, both = _bit_counts(nodes)
    if max_bits >= 64 or n < 2:
        return [(list(range(64)), max_bits)] if max_bits < 3 else [([], 0)]
    p = np.diag(both) / n
    q = 2 * p * (1 - p)
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    plans = {m: group_bits(n, both, m) for m in range(max(2, max_bits - 1), max_bits + 3)}
    pairs = _pairs_in_values(nodes, [g for gs in plans.values() for g in gs])
    at = 0
    for m, groups in plans.items():
        cost = []
        for g in groups:
            near = within(q[g], max_bits)
            row = [0.0]
            for t in range(min(2, max_bits) + 1):
                candidates = min(n * (n - 1) / 2, pairs[at] * near[t] / max(near[0], 1e-300)) if pairs[at] else n * n / 2 * near[t]
                row.append(ROW_COST * n * len(_masks(g, t)) + PAIR_COST * candidates)
            cost.append(row)
            at += 1
        total = max_bits - m + 1
        found = allocate(cost, total)
        if best is None or found[0] < best[0]:
            best = (found[0], [(g, t) for g, t in zip(groups, found[1], strict=True) if t >= 0])
    return best[1]


# ------------------------------------------------------------- probe and verify


def _linked_stars(key: np.ndarray, fp: np.ndarray, own: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (member, smallest member) of the linked sets in each run of equal keys."""
    out_a, out_b = [], []
    cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    size = np.diff(cuts).astype(np.int64)
    work = np.cumsum(size * size)
    lo = 0
    while lo < len(size):  # as many whole runs as make about four million pairs
        done = work[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(work, done + 4_000_000)))
        a, b = cuts[lo], cuts[hi]
        k, f, o = key[a:b], fp[a:b], own[a:b]
        left, right = [], []
        at = np.flatnonzero(np.repeat(size[lo:hi] > 1, size[lo:hi]))
        lag = 1
        while len(at):
            at = at[at + lag < len(k)]
            at = at[k[at] == k[at + lag]]
            hit = at[(o[at] | o[at + lag]) & (np.bitwise_count(f[at] ^ f[at + lag]) <= max_bits)]
            left.append(hit)
            right.append(hit + lag)
            lag += 1
        if left:
            label = np.arange(len(k))
            x, y = np.concatenate(left), np.concatenate(right)
            while True:  # smallest index reachable
                low = np.minimum(label[x], label[y])
                old = label.copy()
                np.minimum.at(label, x, low)
                np.minimum.at(label, y, low)
                label = label[label]
                if (label == old).all():
                    break
            tip = np.flatnonzero(label != np.arange(len(k)))
            tip = tip[f[tip] != f[label[tip]]]
            out_a.append(f[tip])
            out_b.append(f[label[tip]])
        lo = hi
    if not out_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_a).view(np.int64), np.concatenate(out_b).view(np.int64)


def _verify(max_bits: int):
    """mapInPandas step over rows sorted by bucket; a bucket may span Arrow batches."""

    def stars(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = _linked_stars(rows["bucket"].to_numpy(np.int64), rows["fp"].to_numpy(np.int64).view(np.uint64), rows["own"].to_numpy(bool), max_bits)
        return pd.DataFrame({"a": np.maximum(a, b), "b": np.minimum(a, b)}).drop_duplicates()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for rows in batches:
            rows = rows if kept is None else pd.concat([kept, rows], ignore_index=True)
            if not len(rows):
                continue
            cut = int(np.searchsorted(rows["bucket"].to_numpy(), rows["bucket"].iloc[-1], "left"))
            kept = rows.iloc[cut:].reset_index(drop=True)
            if cut:
                yield stars(rows.iloc[:cut])
        if kept is not None and len(kept):
            yield stars(kept)

    return run


def links(nodes: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """Edges (a > b) that connect exactly the fingerprints linked by at most ``max_bits``
    differing bits; ``nodes`` holds distinct fingerprints ``fp``."""
    probes = []
    for i, (bits, t) in enumerate(choose_partitions(nodes, max_bits)):
        mask = F.lit(mask_of(bits))
        for j, flip in enumerate(_masks(bits, t)):
            value = F.col("fp").bitwiseXOR(F.lit(flip)).bitwiseAND(mask)
            probes.append(F.struct(F.lit(i).alias("part"), value.alias("value"), F.lit(j == 0).alias("own")))
    routed = materialise(nodes.select("fp", F.explode(F.array(*probes)).alias("p")).select("p.part", "p.value", "p.own", "fp"), "simhash-routed")
    heavy = routed.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block)
    heavy = materialise(heavy.select("part", "value", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "simhash-heavy")
    rows = routed.join(heavy, ["part", "value"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = rows.select("part", "value", "own", "fp", mine.alias("mine"), other)
    pair = (F.least("mine", "other"), F.greatest("mine", "other"))
    rows = rows.select(F.xxhash64("part", "value", *pair).alias("bucket"), "own", "fp")
    rows = rows.repartition("bucket").sortWithinPartitions("bucket", "fp")
    return rows.mapInPandas(_verify(max_bits), "a long, b long").distinct()


# ------------------------------------------------------------------ components


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge: root is the smallest node reachable.

    Alternating large-star and small-star steps on (a > b) edges; each is an aggregate
    with map-side combine and a join whose large keys Spark can split."""
    edges = materialise(edges.select("a", "b").distinct(), "cc-edges")
    while True:
        both = materialise(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "cc-both")
        low = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")), "cc-low")
        large = both.join(low, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = materialise(large.filter(F.col("a") != F.col("b")).distinct(), "cc-large")
        low = materialise(large.groupBy("a").agg(F.min("b").alias("low")), "cc-low2")
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        small = small.filter(F.col("a") != F.col("b")).unionByName(low.select("a", F.col("low").alias("b")))
        new = materialise(small.distinct(), "cc-edges")
        # unchanged: same number of edges and none that the old set lacks
        moved = new.join(edges, ["a", "b"], "left_anti").limit(1).count()
        if not moved and new.count() == edges.count():
            return new.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                new.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        edges = new


def near_duplicates(rows: DataFrame, key: Column, text: Column, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(key, fp, low) of every row: its key, its fingerprint and the smallest key of its
    group (null keys count last).  ``key`` may be any orderable column."""
    own = materialise(rows.select(key.alias("key"), fingerprint_udf(shingle)(text).alias("fp")), "simhash-fp")
    nodes = materialise(own.groupBy("fp").agg(F.min("key").alias("low")), "simhash-nodes")
    root = materialise(components(links(nodes, max_bits)), "simhash-roots")
    rooted = nodes.join(root, nodes["fp"] == root["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "low")
    rooted = materialise(rooted, "simhash-rooted")
    lows = materialise(rooted.groupBy("root").agg(F.min("low").alias("low")), "simhash-lows")
    classes = materialise(rooted.drop("low").join(lows, "root").select("fp", "low"), "simhash-classes")
    return own.join(classes, "fp").select("key", "fp", "low")


def simhash_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of ``docs``."""
    got = near_duplicates(docs, F.col("doc_id"), F.col("text"))
    return got.select(F.col("key").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("low").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one row of each group left: the smallest doc_id (ids
    before null); among rows of one id the first in the order of two 64-bit hashes over all
    columns, so the choice does not depend on partitions and rows that differ anywhere are
    told apart.  Rows equal in all columns are one row.  All columns, whole texts."""
    h1, h2, m1, m2 = unused(docs, "__h1", "__h2", "__m1", "__m2")
    every = [F.col(f"`{c}`") for c in docs.columns]
    hashes = [F.xxhash64(*every), F.xxhash64(F.lit(1), *reversed(every))]
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), hashes[0].alias("h1"), hashes[1].alias("h2"))
    stay = near_duplicates(docs, key, F.col("text")).select(F.col("low.h1").alias(m1), F.col("low.h2").alias(m2)).distinct()
    stay = materialise(stay, "simhash-stay")
    # plain columns as keys: the rows stay where the join put them when repeated ones are dropped
    kept = docs.withColumns({h1: hashes[0], h2: hashes[1]}).join(stay, (F.col(h1) == F.col(m1)) & (F.col(h2) == F.col(m2)), "left_semi")
    return kept.dropDuplicates([h1, h2]).drop(h1, h2)
