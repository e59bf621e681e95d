"""Quality scores from a generalised additive model with pairwise interactions.

Every text is described by the statistics of ``FEATURES``.  The model is a sum of lookup
tables: one for each statistic over its bins, and one for each of the chosen pairs over a
grid of coarser bins.  Tables are learned by cyclic boosting: in turn every statistic gets a
tree of at most three leaves over its bins, a small step on the logistic loss, until a held
back part of the sample stops improving; then the pairs whose best two-cut tree explains
most of what is left are boosted in turn the same way.  A score is an intercept and a few
additions of table entries, for a whole batch at a time.

Labels are learned from a bounded sample of labelled rows outside the held-out fold
(``ROWS`` of each label, by hash of the id); only the statistics of these rows reach the
driver.  Labels, language, source and id are never inputs.

Defined results: a null text scores like an empty one; without labelled rows every score is
0.5; with one label only, the score is that label's smoothed share; labels other than 0 and
1 are ignored; a document labelled twice counts once, by its smaller label.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import fold

FEATURES = (
    "log_words", "word_chars", "symbols", "capitals", "digits", "stops", "shouts", "quotes", "non_ascii",
    "distinct_words", "top_word", "repeated_runs", "repeated_lines", "line_words", "short_words", "char_entropy",
)
#: Bound of the training sample: rows of each label.
ROWS = 3000
BINS, PAIR_BINS, PAIRS = 32, 8, 10
RATE, ROUNDS, PATIENCE, SHRINK = 0.15, 300, 20, 1.0
THRESHOLD = 0.5
RUN = 3

_WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def _classes() -> np.ndarray:
    """Byte classes: 1 capital, 2 digit, 3 symbol, 4 stop, 5 shout, 6 quote, 7 beyond ASCII."""
    out = np.zeros(256, np.int64)
    for k, chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>{}=_~^\\@", b".,;:", b"!?", b"\"'()[]`"), 1):
        out[list(chars)] = k
    out[128:] = 7
    return out


_CLASS = _classes()


def describe(text: str | None) -> list[float]:
    """The statistics of a whole text; shares are of its words or bytes."""
    raw = (text or "").encode("utf-8", "replace")
    words = _WORD.findall(raw)
    n, size = len(words), max(len(raw), 1)
    if not n:
        return [0.0] * len(FEATURES)
    freq = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kinds = np.bincount(_CLASS, weights=freq, minlength=8)
    p = freq[freq > 0] / size
    seen = Counter(words)
    runs = len(set(zip(*(words[k:] for k in range(RUN)), strict=False))) if n >= RUN else n
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [
        np.log1p(n), sum(map(len, words)) / n, kinds[3] / n, kinds[1] / size, kinds[2] / size, kinds[4] / n, kinds[5] / n, kinds[6] / n, kinds[7] / size,
        len(seen) / n, max(seen.values()) / n, 1 - runs / max(n - RUN + 1, runs), 1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)),
        sum(len(w) <= 3 for w in words) / n, float(-(p * np.log2(p)).sum()),
    ]


# ----------------------------------------------------------------------- model


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _leaf(g, h):
    return g / (h + SHRINK)


def _gain(g, h):
    return g * g / (h + SHRINK)


def line_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Steps of the best tree of up to three leaves over ordered bins with gradient sums ``g``
    and curvature sums ``h``: the best cut, then the best further cut on either side."""

    def best(lo: int, hi: int) -> tuple[float, int]:
        gs, hs = np.cumsum(g[lo:hi]), np.cumsum(h[lo:hi])
        if hi - lo < 2:
            return 0.0, lo
        won = _gain(gs[:-1], hs[:-1]) + _gain(gs[-1] - gs[:-1], hs[-1] - hs[:-1]) - _gain(gs[-1], hs[-1])
        k = int(won.argmax())
        return float(won[k]), lo + k + 1

    won, cut = best(0, len(g))
    ends = [0, len(g)] if won <= 0 else [0, cut, len(g)]
    if len(ends) == 3:
        won, further = max(best(0, cut), best(cut, len(g)))
        ends = sorted({*ends, further}) if won > 0 else ends
    out = np.zeros(len(g))
    for a, b in zip(ends, ends[1:], strict=False):
        out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum())
    return out


def grid_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and steps of the best tree that cuts both axes of a grid once."""
    gs, hs = (np.pad(x, ((1, 0), (1, 0))).cumsum(0).cumsum(1) for x in (g, h))

    def quarters(s):
        low, left, up = s[1:-1, 1:-1], s[1:-1, -1:], s[-1:, 1:-1]
        return np.stack([low, left - low, up - low, s[-1, -1] - left - up + low])

    qg, qh = quarters(gs), quarters(hs)
    won = _gain(qg, qh).sum(0)
    i, j = np.unravel_index(int(won.argmax()), won.shape)
    leaf = _leaf(qg[:, i, j], qh[:, i, j])
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = leaf
    return float(won[i, j] - _gain(gs[-1, -1], hs[-1, -1])), out


class Additive:
    """Cuts of every statistic, its table, and tables of the pairs."""

    def __init__(self, x: np.ndarray):
        inner = np.linspace(0, 1, BINS + 1)[1:-1]
        self.cuts = [np.unique(np.quantile(c, inner)) for c in x.T] if len(x) else []
        #: coarse bin of every fine bin
        self.coarse = [np.arange(len(c) + 1) * PAIR_BINS // (len(c) + 1) for c in self.cuts]
        self.base, self.tables, self.pairs = 0.0, [np.zeros(len(c) + 1) for c in self.cuts], {}

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Bin numbers (statistic, row)."""
        return np.stack([np.searchsorted(c, v, "right") for c, v in zip(self.cuts, x.T, strict=True)])

    def logit(self, at: np.ndarray) -> np.ndarray:
        out = np.full(at.shape[1], self.base)
        for table, k in zip(self.tables, at, strict=True):
            out += table[k]
        for (i, j), table in self.pairs.items():
            out += table[self.coarse[i][at[i]], self.coarse[j][at[j]]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logit(self.bins(x))) if self.cuts else np.full(len(x), _sigmoid(np.float64(self.base)))


def train(x: np.ndarray, y: np.ndarray) -> Additive:
    """Fit to statistics ``x`` (row, statistic) and labels ``y`` (0 or 1)."""
    model = Additive(x if 0 < y.sum() < len(y) else x[:0])
    model.base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    if not model.cuts:
        return model
    at = model.bins(x)
    check = np.arange(len(y)) % 5 == 4  # held back to end the boosting
    if len(set(y[check])) < 2:
        check[:] = False
    learn = ~check

    def slopes(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = _sigmoid(f)
        return np.where(learn, y - p, 0), np.where(learn, p * (1 - p), 0)

    def loss(f: np.ndarray) -> float:
        part = check if check.any() else learn
        return float(np.mean(np.logaddexp(0, np.where(y[part] == 1, -f[part], f[part]))))

    def boost(tables, cells, tree) -> None:
        """Rounds over all ``tables`` (flat lookup by ``cells``); the best state is kept."""
        f = model.logit(at)
        best, kept, stale = loss(f), [t.copy() for t in tables], 0
        for _ in range(ROUNDS):
            for table, k in zip(tables, cells, strict=True):
                g, h = slopes(f)
                sums = (np.bincount(k, w, table.size).reshape(table.shape) for w in (g, h))
                step = RATE * tree(*sums)
                table += step
                f = f + step.ravel()[k]
            now = loss(f)
            stale = 0 if now < best - 1e-5 else stale + 1
            if now < best:
                best, kept = now, [t.copy() for t in tables]
            if stale >= PATIENCE:
                break
        for table, k in zip(tables, kept, strict=True):
            table[...] = k

    boost(model.tables, list(at), line_tree)
    g, h = slopes(model.logit(at))
    coarse = [c[k] for c, k in zip(model.coarse, at, strict=True)]
    found = []
    for i in range(len(coarse)):
        for j in range(i + 1, len(coarse)):
            shape = (PAIR_BINS, PAIR_BINS)
            k = coarse[i] * PAIR_BINS + coarse[j]
            won, _ = grid_tree(*(np.bincount(k, w, PAIR_BINS**2).reshape(shape) for w in (g, h)))
            found.append((-won, i, j, k))
    found.sort(key=lambda r: r[:3])
    model.pairs = {(i, j): np.zeros((PAIR_BINS, PAIR_BINS)) for _, i, j, _ in found[:PAIRS]}
    boost(list(model.pairs.values()), [k for *_, k in found[:PAIRS]], lambda g, h: grid_tree(g, h)[1])
    return model


# ------------------------------------------------------------------ Spark side


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id, 3) == 1, F.lit(False))


def described(text: str) -> Column:
    """The statistics of a text column."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([describe(t if isinstance(t, str) else None) for t in texts])

    return F.pandas_udf(run, "array<double>")(text)


def training_rows(docs: DataFrame, labels: DataFrame, may_train: Column, rows: int = ROWS) -> DataFrame:
    """doc_id, x, y of at most ``rows`` rows of each label.  Ids are chosen on the label table,
    at most twice ``rows`` of them, so the list is broadcast; texts are described where they lie."""
    known = labels.filter(may_train & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"))
    picked = [known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for y in (0, 1)]
    ids = picked[0].unionByName(picked[1])
    got = docs.join(F.broadcast(ids), "doc_id").select("doc_id", "y", described("text").alias("x"))
    # repeated ids cannot make the sample larger
    return got.orderBy(F.xxhash64("doc_id"), "x").limit(2 * rows)


def fit(docs: DataFrame, labels: DataFrame, may_train: Column, rows: int = ROWS) -> Additive:
    got = training_rows(docs, labels, may_train, rows).collect()
    return train(np.array([r["x"] for r in got], float).reshape(-1, len(FEATURES)), np.array([r["y"] for r in got], float))


def scorer(model: Additive):
    """Pandas UDF: text -> score; the model's tables have a fixed size."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            x = np.array([describe(t if isinstance(t, str) else None) for t in s], float).reshape(-1, len(FEATURES))
            yield pd.Series(model.score(x))

    return score


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text)."""
    own = docs.select("doc_id", "text")
    model = fit(own, labels.select("doc_id", "quality"), ~held_out(F.col("doc_id")))
    scored = own.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scorer(model)("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
