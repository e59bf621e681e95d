"""Additive quality model, Merkle manifest and importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.llm import additive_quality as A
from runlens.llm import merkle_manifest as M
from runlens.llm import overlap_resampling as R
from tests.conftest import SF_CHECK, SF_SMALL
from tests.llm.test_operators import ODD, docs

# ------------------------------------------------------------------ 11 quality


def rows_of(n, seed=1):
    """Clean and junk texts; junk differs by symbols, by repetition, or by shouting in short texts only."""
    rng, out = random.Random(seed), []
    vocab = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randint(20, 200))]
        kind, good = i % 6, 1
        if kind == 0:
            w, good = [x + "%%%" for x in w], 0
        elif kind == 1:
            w, good = w[:4] * 20, 0
        out.append((i, " ".join(w), good))
    return out


def test_quality_holds_out_and_learns(spark):
    rows = rows_of(600)
    d = docs(spark, [(i, t, "en", "s", "x", "y") for i, t, _ in rows])
    labels = spark.createDataFrame([(i, q, 0.5) for i, _, q in rows] + [(3, 7, 0.1), (None, 1, 0.2)], "doc_id long, quality int, score double")
    got = {r.doc_id: r for r in A.quality(d, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    held = [(got[i].predicted, q) for i, _, q in rows if got[i].held_out]
    assert len(held) > 100 and sum(p == q for p, q in held) / len(held) >= 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())


def test_labels_of_the_held_out_fold_do_not_matter(spark):
    rows = rows_of(300)
    d = docs(spark, [(i, t, "en", "s", None, None) for i, t, _ in rows])
    flip = lambda i, q: 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q
    a, b = (spark.createDataFrame([(i, f(i, q)) for i, _, q in rows], "doc_id long, quality int") for f in (lambda i, q: q, flip))
    assert sorted(A.quality(d, a).collect()) == sorted(A.quality(d, b).collect())


def test_score_is_the_sum_of_table_entries():
    rows = rows_of(400)
    x, y = np.array([A.describe(t) for _, t, _ in rows]), np.array([q for *_, q in rows], float)
    m = A.train(x, y)
    assert len(m.pairs) == A.PAIRS
    for row, score in zip(x[:40], m.score(x[:40]), strict=True):
        at = [sum(v >= c for c in cuts) for v, cuts in zip(row, m.cuts, strict=True)]
        total = m.base + sum(t[k] for t, k in zip(m.tables, at, strict=True))
        total += sum(t[m.coarse[i][at[i]], m.coarse[j][at[j]]] for (i, j), t in m.pairs.items())
        assert score == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-9)


def test_pairs_learn_what_no_single_statistic_shows():
    rng = np.random.default_rng(0)
    x = np.zeros((3000, len(A.FEATURES)))
    x[:, 0], x[:, 5] = rng.random(3000), rng.random(3000)
    y = ((x[:, 0] > 0.5) ^ (x[:, 5] > 0.5)).astype(float)
    m = A.train(x, y)
    assert (0, 5) in m.pairs and ((m.score(x) >= 0.5) == y).mean() > 0.95
    m.pairs = {}
    assert ((m.score(x) >= 0.5) == y).mean() < 0.7


def test_trees_are_the_best_of_all_cuts():
    rng = np.random.default_rng(1)
    g, h = rng.normal(size=9), rng.random(9) + 0.1
    gain = lambda parts: sum(A._gain(g[p].sum(), h[p].sum()) for p in parts)
    one = max(range(1, 9), key=lambda k: gain([slice(0, k), slice(k, 9)]))
    two = max((k for k in range(1, 9) if k != one), key=lambda k: gain([slice(0, min(k, one)), slice(min(k, one), max(k, one)), slice(max(k, one), 9)]))
    ends = [0, min(one, two), max(one, two), 9]
    want = np.concatenate([np.full(b - a, A._leaf(g[a:b].sum(), h[a:b].sum())) for a, b in zip(ends, ends[1:], strict=False)])
    assert A.line_tree(g, h) == pytest.approx(want)
    g, h = rng.normal(size=(5, 5)), rng.random((5, 5)) + 0.1
    quarter = lambda i, j: [(slice(0, i), slice(0, j)), (slice(0, i), slice(j, 5)), (slice(i, 5), slice(0, j)), (slice(i, 5), slice(j, 5))]
    value = lambda i, j: sum(A._gain(g[q].sum(), h[q].sum()) for q in quarter(i, j))
    i, j = max(((i, j) for i in range(1, 5) for j in range(1, 5)), key=lambda c: value(*c))
    want = np.empty((5, 5))
    for q in quarter(i, j):
        want[q] = A._leaf(g[q].sum(), h[q].sum())
    won, got = A.grid_tree(g, h)
    assert got == pytest.approx(want) and won == pytest.approx(value(i, j) - A._gain(g.sum(), h.sum()))


def test_quality_odd_inputs(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = A.quality(docs(spark), none).collect()
    assert len(got) == len(ODD) and {r.score for r in got} == {0.5}
    one = spark.createDataFrame([(4, 1), (5, 1), (6, 1), (7, 1), (8, 1)], "doc_id long, quality int")
    got = A.quality(docs(spark), one).collect()
    assert len({r.score for r in got}) == 1 and got[0].score > 0.5
    assert A.quality(docs(spark, []), one).count() == 0


# ------------------------------------------------------------------ 12 manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows, fanout=16):
    """The manifest with plain lists: trees, proofs and refolded roots."""
    value = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: sha(*(value(r[c]) for c in ("doc_id", "source", "lang", "n_chars")), value(t))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha(*levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
        return levels

    def siblings(levels, i):
        for level in levels[:-1]:
            a = i // fanout * fanout
            yield level[a:i], level[i + 1 : a + fanout]
            i //= fanout

    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        rs = sorted(by[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        trees[s] = rs, tree([leaf(r, r["text"]) for r in rs])
    top = tree([trees[s][1][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        rs, levels = trees[s]
        for i, r in enumerate(rs):
            near = [*siblings(levels, i), *siblings(top, k)]
            text = r["text"]
            if text is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0:
                text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
            node = leaf(r, text)
            for left, right in near:
                node = sha(*left, node, *right)
            proof = sha(*(x for left, right in near for x in left + right))
            out.append((r["doc_id"], levels[0][i], levels[-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(map(str, out))


COLUMNS = "doc_id long, source string, lang string, n_chars long, text string, leaf string, pos int"


def sources_of(sizes):
    rows, at = [], 0
    for s, n in sizes:
        for _ in range(n):
            rows.append((at, s, ["en", None][at % 2], at * 3, f"Text {at} Ünd", "x", 1))
            at += 1
    return rows


@pytest.mark.parametrize(
    ("sizes", "fanout", "storey"),
    [
        ([("a", 1)], 16, 3),
        ([("a", 16), ("b", 17), ("é", 1), (None, 33), ("B", 2)], 16, 3),
        ([("a", 300)], 16, 2),
        ([("a", 70), ("b", 9), ("c", 8)], 2, 2),
        ([(f"s{i}", 1 + i % 3) for i in range(40)], 3, 1),
    ],
)
def test_manifest_matches_plain_trees(spark, sizes, fanout, storey):
    df = spark.createDataFrame(sources_of(sizes), COLUMNS)
    got = [tuple(r) for r in M.proofs(df, M.tampered_text(), fanout, storey).collect()]
    assert sorted(map(str, got)) == plain_manifest([r.asDict() for r in df.collect()], fanout)


def test_manifest_of_the_table_and_of_odd_rows(spark):
    d = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert sorted(str(tuple(r)) for r in M.manifest(d).collect()) == plain_manifest([r.asDict() for r in d.collect()])
    odd = docs(spark).withColumn("n_chars", F.length("text").cast("long")).withColumn("leaf", F.lit("x"))
    assert sorted(str(tuple(r)) for r in M.manifest(odd).collect()) == plain_manifest([r.asDict() for r in odd.collect()])
    assert M.manifest(odd.limit(0)).count() == 0


def test_folding_resumes_the_state_before_the_slot():
    nodes = [sha(str(i)).encode() for i in range(40)]
    levels = M.levels_of(nodes, 2)
    for at in (0, 15, 16, 39):
        assert M.fold_up(levels, at, nodes[at]) == levels[-1][0].digest
        other = sha("other").encode()
        again = M.levels_of([*nodes[:at], other, *nodes[at + 1 :]], 2)
        assert M.fold_up(levels, at, other) == again[-1][0].digest != levels[-1][0].digest
    parent = M.Parent(nodes[:5])
    assert [s.copy().hexdigest() for s in parent.states] == [hashlib.sha256(b"".join(nodes[:k])).hexdigest() for k in range(5)]


# --------------------------------------------------------------- 13 resampling


def plain_resample(rows, target, percent=5, n=10_000):
    """Word lists joined to n-grams, counted in dictionaries."""
    def grams(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return len(w), [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]

    code = lambda g: zlib.crc32(g.encode()) % n
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(code, grams(text)[1]))
    for text in target:
        t.update(map(code, grams(text)[1]))
    gain = [math.floor(1000 * math.log((t[k] + 1) * (s.total() + n) / ((s[k] + 1) * (t.total() + n)))) for k in range(n)]
    out = []
    for i, text in rows:
        words, g = grams(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[code(x)] for x in g)
        out.append([i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = k
    return sorted(str(tuple(r[:5])) for r in out)


def test_spans_are_all_runs_of_words():
    clean = R.normal("Don't STOP—Ünder 日本 a1b\n2".encode())
    assert clean == " don t stop—Ünder 日本 a1b 2 ".encode()
    got = sorted(clean[a:b].decode() for a, b in R.spans(clean))
    words = clean.decode().split()
    assert got == sorted(" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    assert list(R.spans(R.normal(b" .,; "))) == [] and list(R.spans(R.normal(b"one"))) == [(1, 4)]


def test_resampling_matches_plain_counts(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(50)]
    rows = [(i, " ".join(rng.choices(vocab, k=rng.randint(0, 60)))) for i in range(300)]
    rows += [(None, " ".join(vocab)), (None, None), (7, "A b c " * 10), (7, "A b c " * 10), (900, "İ\u0000x " * 30), (901, "lone"), (902, "word " * 20_000)]
    d = spark.createDataFrame([(i, t, "w1 w2", 3) for i, t in rows], "doc_id long, text string, id string, grams int")
    aim = spark.createDataFrame([("w1 w2 w3 w4",), ("w1 w2 W3",), (None,), ("",)], "text string")
    got = sorted(str(tuple(r)) for r in R.resample(d, aim, percent=20).collect())
    assert got == plain_resample(rows, [r.text for r in aim.collect()], 20)


def test_resampling_of_the_table(spark):
    d, b = (spark.read.parquet(f"{SF_CHECK}/{t}.parquet") for t in ("documents", "benchmark"))
    want = plain_resample([(r.doc_id, r.text) for r in d.collect()], [r.text for r in b.collect()])
    assert sorted(str(tuple(r)) for r in R.resample(d, b).collect()) == want


def test_resampling_empty_tables(spark):
    d, none = docs(spark), docs(spark, [])
    assert R.resample(none, d).count() == 0
    got = R.resample(d, none, percent=100).collect()
    assert len(got) == len(ODD) and sorted(r.rank for r in got if r.rank) == list(range(1, 1 + sum(len((t or "").split()) >= 20 for _, t, *_ in ODD)))
