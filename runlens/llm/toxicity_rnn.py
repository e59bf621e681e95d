"""Toxicity scores from a bidirectional gated recurrent network with attention pooling.

Inputs of each word: a learned vector of the (hashed) word and the mean of learned
vectors of its (hashed) character trigrams.  A forward and a backward GRU read a window
of words, attention pools the states, a logistic unit gives the window's score.  A text
is cut into overlapping windows that together cover every word; its score is the largest
window score, so one abusive passage in a long text counts as much as a short text.

Training (numpy, on a bounded sample): rows carry one label for the whole text, so each
epoch takes from every sampled text the window that scores highest at that time
(multiple-instance learning; a random one in the first epoch), back-propagates through
time and updates with Adam.  Labels, language, source and id are never inputs.

Defined results: null text or text without a letter -> score 0.0.  No labelled rows, or one
label only -> score 0.0 for every text.  Labels other than 0 and 1 are ignored; a document labelled
twice counts once, by its larger label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import Words, bounded_rows, fold, text_blocks

#: Window and step in words; every run of up to ``WINDOW - STEP + 1`` words lies whole in a
#: window.  Training looks at every fourth of these windows.
WINDOW, STEP, TRAIN_STEP = 24, 4, 16
WORD_BITS, GRAM_BITS, WORD_DIM, GRAM_DIM, HIDDEN, ATT = 15, 12, 12, 8, 12, 8
#: Bound of the training sample: rows of each label, windows used of one row.
TOXIC_ROWS, OTHER_ROWS, WINDOWS_PER_ROW = 1500, 2000, 32
THRESHOLD = 0.7
DECAY, MIN_UPDATES = 1e-4, 250


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _inputs(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets, trigram buckets of all letter bytes, first trigram of each word."""
    word = (w.hashes() >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    size = w.end - w.start
    first = np.cumsum(size) - size
    pos = np.arange(size.sum()) - np.repeat(first - w.start, size)
    a, b, c = (w.norm[pos + k].astype(np.uint64) for k in (-1, 0, 1))
    code = ((a << np.uint64(16)) | (b << np.uint64(8)) | c) * np.uint64(0x9E3779B97F4A7C15)
    return word, (code >> np.uint64(64 - GRAM_BITS)).astype(np.int64), first


def windows(n_words: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first word (within the batch) and length of every window."""
    count = np.where(n_words > 0, 1 + np.maximum(0, -(-(n_words - WINDOW) // step)), 0)
    doc = np.repeat(np.arange(len(n_words)), count)
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    lo = k * step
    base = np.cumsum(n_words) - n_words
    return doc, base[doc] + lo, np.minimum(WINDOW, n_words[doc] - lo)


def _gather(first: np.ndarray, size: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the trigrams of the picked words, and which pick each belongs to."""
    reps = size[pick]
    at = np.repeat(first[pick] - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())
    return at, np.repeat(np.arange(len(pick)), reps)


class Corpus:
    """Texts as numbers of distinct words: ``token`` the words in order; ``word``, ``gram``,
    ``first``, ``size`` the inputs of each distinct word; ``doc``, ``lo``, ``n`` the windows.
    Texts are read in blocks, so only these compact arrays grow with them."""

    def __init__(self, texts: list[str], step: int = STEP, block_chars: int = 1 << 20):
        keys, words, grams, sizes, tokens, counts = [], [], [], [], [], []
        for a, b in text_blocks(texts, block_chars):
            w = Words(texts[a:b])
            word, gram, first = _inputs(w) if len(w.start) else (np.zeros(0, int),) * 3
            key, at, inv = np.unique(w.hashes(), return_index=True, return_inverse=True)
            size = (w.end - w.start)[at]
            tokens.append(inv.astype(np.int32) + sum(map(len, keys)))
            keys.append(key)
            words.append(word[at].astype(np.int32))
            sizes.append(size)
            grams.append(gram[_gather(first, w.end - w.start, at)[0]].astype(np.int16))
            counts.append(np.bincount(w.doc, minlength=w.n_docs))
        join = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
        size = join(sizes, np.int64)
        first = np.cumsum(size) - size
        _, at, inv = np.unique(join(keys, np.uint64), return_index=True, return_inverse=True)
        self.token = inv.astype(np.int32)[join(tokens, np.int32)]
        self.word, self.size = join(words, np.int32)[at], size[at]
        self.gram = join(grams, np.int16)[_gather(first, size, at)[0]]
        self.first = np.cumsum(self.size) - self.size
        self.doc, self.lo, self.n = windows(join(counts, np.int64), step)


class GRU:
    def __init__(self, params: dict[str, np.ndarray]):
        self.p = params

    @staticmethod
    def fresh(seed: int) -> GRU:
        rng = np.random.default_rng(seed)
        d, h = WORD_DIM + GRAM_DIM, HIDDEN

        def w(*shape: int, scale: float | None = None) -> np.ndarray:
            return rng.normal(0, scale or 1 / np.sqrt(shape[0]), shape).astype(np.float32)

        # an unseen word adds nothing of its own: only its characters speak for it
        p = {"word": np.zeros((1 << WORD_BITS, WORD_DIM), np.float32), "gram": w(1 << GRAM_BITS, GRAM_DIM, scale=0.1)}
        for s in "fb":
            p |= {f"W{s}": w(d, 3 * h), f"U{s}": w(h, 3 * h), f"c{s}": np.zeros(3 * h, np.float32)}
        p |= {"A": w(2 * h, ATT), "a": w(ATT), "v": w(2 * h), "o": np.full(1, -2.0, np.float32)}
        return GRU(p)

    def word_inputs(self, word, gram, first, size) -> np.ndarray:
        """Input vector of each word: its own and the mean of its trigrams'."""
        p = self.p
        chars = np.add.reduceat(p["gram"][gram], first, axis=0) / size[:, None].astype(np.float32)
        return np.concatenate([p["word"][word], chars], 1)

    def states(self, xs: np.ndarray, live: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        """States (T, B, H) of one direction over gate inputs ``xs`` (T, B, 3H)."""
        n_t, n_b, _ = xs.shape
        h, u = HIDDEN, self.p[f"U{side}"]
        out = np.zeros((n_t, n_b, h), np.float32)
        cur = np.zeros((n_b, h), np.float32)
        for t in range(n_t) if side == "f" else range(n_t - 1, -1, -1):
            hu = cur @ u
            zr = 1.0 / (1.0 + np.exp(-(xs[t, :, : 2 * h] + hu[:, : 2 * h])))
            z, r = zr[:, :h], zr[:, h:]
            n = np.tanh(xs[t, :, 2 * h :] + r * hu[:, 2 * h :])
            new = n + z * (cur - n)
            nxt = np.where(live[t][:, None], new, cur)
            if keep is not None:
                keep.append((t, cur, z, r, n, hu[:, 2 * h :]))
            cur = nxt
            out[t] = nxt
        return out

    def pool(self, hs: np.ndarray, live: np.ndarray):
        """Attention weights (T, B), pooled state (B, 2H) and logit (B)."""
        p = self.p
        u = np.tanh(hs @ p["A"])
        s = np.where(live, u @ p["a"], -1e9)
        w = np.exp(s - s.max(0))
        w /= w.sum(0)
        pooled = np.einsum("tb,tbh->bh", w, hs)
        return u, w, pooled, pooled @ p["v"] + p["o"][0]

    def _columns(self, gates: np.ndarray, idx: np.ndarray, live: np.ndarray, side: str) -> np.ndarray:
        """:meth:`states` with one column per window, (T, H, B), over gate inputs of distinct
        words; all steps work in place on contiguous rows."""
        (n_t, n_b), h = idx.shape, HIDDEN
        u, out = np.ascontiguousarray(self.p[f"U{side}"].T), np.empty((n_t, h, n_b), np.float32)
        cur, hu, full = np.zeros((h, n_b), np.float32), np.empty((3 * h, n_b), np.float32), live.all(1)
        for t in range(n_t) if side == "f" else range(n_t - 1, -1, -1):
            x = np.ascontiguousarray(gates[idx[t]].T)
            np.dot(u, cur, out=hu)
            zr, n, new = x[: 2 * h], hu[2 * h :], out[t]
            zr += hu[: 2 * h]
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            n *= zr[h:]
            n += x[2 * h :]
            np.tanh(n, out=n)
            np.subtract(cur, n, out=new)
            new *= zr[:h]
            new += n
            if not full[t]:
                np.copyto(new, cur, where=~live[t])
            cur = new
        return out

    def window_scores(self, c: Corpus) -> np.ndarray:
        """Score of every window of the corpus; gate inputs are computed once for each
        distinct word."""
        out, p = np.empty(len(c.doc)), self.p
        if not len(out):
            return out
        x = self.word_inputs(c.word, c.gram, c.first, c.size)
        gates = {s: (x @ p[f"W{s}"] + p[f"c{s}"]).astype(np.float32) for s in "fb"}
        for b in range(0, len(out), 2048):
            lo, n = c.lo[b : b + 2048], c.n[b : b + 2048]
            t = np.arange(int(n.max()))[:, None]
            live = t < n
            idx = c.token[np.minimum(lo + t, lo + n - 1)]
            hs = np.concatenate([self._columns(gates[s], idx, live, s) for s in "fb"], 1)
            at = np.where(live, np.einsum("a,tab->tb", p["a"], np.tanh(p["A"].T @ hs)), -1e9)
            w = np.exp(at - at.max(0))
            told = np.einsum("h,thb->tb", p["v"], hs)
            out[b : b + 2048] = _sigmoid((w * told).sum(0) / w.sum(0) + p["o"][0])
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Largest window score of each whole text."""
        out = np.zeros(len(texts))
        full = [t or "" for t in texts]
        for lo, hi in text_blocks(full, 1 << 20):
            c = Corpus(full[lo:hi])
            np.maximum.at(out, c.doc + lo, self.window_scores(c))
        return out

    def loss_grads(self, word, gram_rows, n, y, keep=None):
        """Mean log loss of a batch of windows and its gradients.

        ``word`` (B, T) buckets, ``gram_rows`` (B*T lists as flat buckets, owner, size), ``n``
        window lengths, ``y`` labels, ``keep`` (B, T) the words whose own vector is read."""
        p, h = self.p, HIDDEN
        n_b, n_t = word.shape
        gram, owner, gsize = gram_rows
        live = np.arange(n_t)[:, None] < n
        chars = np.zeros((n_b * n_t, GRAM_DIM), np.float32)
        np.add.at(chars, owner, p["gram"][gram])
        chars /= gsize[:, None]
        keep = np.ones(word.shape, np.float32) if keep is None else keep
        x = np.concatenate([p["word"][word] * keep[:, :, None], chars.reshape(n_b, n_t, -1)], 2).transpose(1, 0, 2)
        tape: dict[str, list] = {"f": [], "b": []}
        hs = np.concatenate([self.states(x @ p[f"W{s}"] + p[f"c{s}"], live, s, tape[s]) for s in "fb"], 2)
        u, w, pooled, logit = self.pool(hs, live)
        q = _sigmoid(logit)
        loss = float(-np.mean(np.where(y == 1, np.log(q + 1e-7), np.log(1 - q + 1e-7))))
        g: dict[str, np.ndarray] = {}
        d_logit = ((q - y) / n_b).astype(np.float32)
        g["v"], g["o"] = pooled.T @ d_logit, np.array([d_logit.sum()], np.float32)
        d_pool = d_logit[:, None] * p["v"]
        d_hs = w[:, :, None] * d_pool
        d_w = np.einsum("tbh,bh->tb", hs, d_pool)
        d_s = w * (d_w - (w * d_w).sum(0))
        g["a"] = np.einsum("tb,tba->a", d_s, u)
        d_u = d_s[:, :, None] * p["a"] * (1 - u**2)
        g["A"] = np.einsum("tbh,tba->ha", hs, d_u)
        d_hs = d_hs + d_u @ p["A"].T
        d_x = np.zeros_like(x)
        for k, s in enumerate("fb"):
            d_out = d_hs[:, :, k * h : (k + 1) * h]
            big_u = p[f"U{s}"]
            g_u, d_gates = np.zeros_like(big_u), np.zeros((n_t, n_b, 3 * h), np.float32)
            nxt = np.zeros((n_b, h), np.float32)
            for t, prev, z, r, cand, hun in reversed(tape[s]):
                d = d_out[t] + nxt
                m = live[t][:, None]
                dn = np.where(m, d * (1 - z) * (1 - cand**2), 0)
                dz = np.where(m, d * (prev - cand) * z * (1 - z), 0)
                dr = dn * hun * r * (1 - r)
                d_hu = np.concatenate([dz, dr, dn * r], 1)
                g_u += prev.T @ d_hu
                nxt = np.where(m, d * z, d) + d_hu @ big_u.T
                d_gates[t] = np.concatenate([dz, dr, dn], 1)
            flat = d_gates.reshape(-1, 3 * h)
            g[f"U{s}"], g[f"W{s}"], g[f"c{s}"] = g_u, x.reshape(-1, x.shape[2]).T @ flat, flat.sum(0)
            d_x += d_gates @ p[f"W{s}"].T
        d_x = d_x.transpose(1, 0, 2).reshape(n_b * n_t, -1)
        g["word"] = (word.ravel(), d_x[:, :WORD_DIM] * keep.reshape(-1, 1))
        g["gram"] = (gram, (d_x[:, WORD_DIM:] / gsize[:, None])[owner])
        return loss, g


class _Adam:
    def __init__(self, params, rate=0.01):
        self.rate, self.t = rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.s = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, params, grads):
        self.t += 1
        fix = np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            rows = slice(None)
            if isinstance(g, tuple):  # rows of an embedding table
                rows, inv = np.unique(g[0], return_inverse=True)
                total = np.zeros((len(rows), g[1].shape[1]), np.float32)
                np.add.at(total, inv, g[1])
                g = total
            self.m[k][rows] = 0.9 * self.m[k][rows] + 0.1 * g
            self.s[k][rows] = 0.999 * self.s[k][rows] + 0.001 * g**2
            params[k][rows] -= self.rate * fix * self.m[k][rows] / (np.sqrt(self.s[k][rows]) + 1e-8)


def train(texts: list[str], labels: list[int], seed: int = 3, epochs: int = 7, batch: int = 128) -> GRU | None:
    y = np.asarray(labels, np.float32)
    if not len(texts):
        return None
    model, rng = GRU.fresh(seed), np.random.default_rng(seed)
    if (y == 1).sum() == 0 or (y == 0).sum() == 0:
        return None  # one label alone tells nothing about texts
    opt = _Adam(model.p)
    epochs = max(epochs, -(-MIN_UPDATES * batch // (2 * len(texts))))  # a small sample is seen more often
    c = Corpus(texts, TRAIN_STEP)
    if not len(c.doc):
        return None
    for epoch in range(epochs):
        score = model.window_scores(c) if epoch else rng.random(len(c.doc))
        if epoch:  # the highest window of each text, now and then another one
            score = np.where(rng.random(len(score)) < 0.1, rng.random(len(score)), score)
        order = np.lexsort((-score, c.doc))
        pick = order[np.unique(c.doc[order], return_index=True)[1]]
        if epoch:  # and as many random windows of clean texts
            clean = np.flatnonzero(y[c.doc] == 0)
            pick = np.concatenate([pick, clean[rng.permutation(len(clean))][: len(pick)]])
        pick = pick[rng.permutation(len(pick))]
        opt.rate = 0.01 * (1 - epoch / epochs) + 0.001
        for b in range(0, len(pick), batch):
            sel = pick[b : b + batch]
            n = c.n[sel]
            idx = c.token[np.minimum(c.lo[sel][:, None] + np.arange(int(n.max())), (c.lo[sel] + n - 1)[:, None])]
            at, owner = _gather(c.first, c.size, idx.ravel())
            keep = (rng.random(idx.shape) < 0.5).astype(np.float32)
            grams = (c.gram[at].astype(np.int64), owner, c.size[idx.ravel()].astype(np.float32))
            _, g = model.loss_grads(c.word[idx], grams, n, y[c.doc[sel]], keep)
            g["word"] = (g["word"][0], g["word"][1] + DECAY * model.p["word"][g["word"][0]])
            opt.step(model.p, g)
    return model


# ------------------------------------------------------------------ Spark side


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id, 3) == 1, F.lit(False))


def _spread_windows(text: str) -> str:
    """A sampled text for training; of a very long one, evenly spaced pieces of it."""
    words = text.split()
    most = WINDOW * WINDOWS_PER_ROW
    if len(words) <= most:
        return text
    at = np.linspace(0, len(words) - WINDOW, WINDOWS_PER_ROW).astype(int)
    return " ".join(" ".join(words[i : i + WINDOW]) for i in at)


def training_rows(docs: DataFrame, labels: DataFrame, may_train: Column, toxic_rows: int = TOXIC_ROWS, other_rows: int = OTHER_ROWS) -> DataFrame:
    """At most ``toxic_rows`` rows labelled 1 and ``other_rows`` labelled 0, by hash of the
    id.  Ids are chosen on the label table; only the chosen texts are fetched."""
    known = labels.filter(may_train & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    picked = [known.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in ((1, toxic_rows), (0, other_rows))]
    ids = picked[0].unionByName(picked[1])
    rows = docs.filter(F.col("text").isNotNull()).select("doc_id", "text")
    return bounded_rows(ids, rows, toxic_rows + other_rows, ["doc_id", "text", "toxic"], _spread_windows)


def fit(docs: DataFrame, labels: DataFrame, may_train: Column, **bounds: int) -> GRU | None:
    rows = training_rows(docs, labels, may_train, **bounds).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    return train([r["text"] for r in rows], [r["toxic"] for r in rows])


def scorer(model: GRU | None):
    """Pandas UDF: text -> score; the model has a fixed size."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            texts = [t if isinstance(t, str) else None for t in s]
            yield pd.Series(model.score(texts) if model else np.zeros(len(texts)))

    return score


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text)."""
    own = docs.select("doc_id", "text")
    model = fit(own, labels.select("doc_id", "toxic"), ~held_out(F.col("doc_id")))
    scored = own.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scorer(model)("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
