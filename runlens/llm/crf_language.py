"""Language identification with a linear-chain conditional random field.

Every word of a text is labelled with a language; transitions are learned, so a run of
words in another language inside a text (code-switching) is labelled as such, while a
single odd word is pulled to its neighbours.  Emissions are sums of hashed feature
weights: word identity (the learned lexicon), prefixes and suffixes of 1 to 4 bytes, and
byte bi- and trigrams with word edges.

Training (numpy, on a bounded sample of rows): spans of words of differently labelled
texts are spliced into code-switched sequences; the exact log-likelihood is maximised
with Adagrad.  Prediction: exact forward-backward over the whole text.  A text is cut
into blocks only to compute the chain in parallel; block transfer matrices are
multiplied in order, so the marginals are those of the uncut chain.

Defined results: null text or text without a letter -> ``und``, score 0.  No labelled
row to learn from -> ``und`` for every text.  Equal shares -> the smaller language name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.common import Words, bounded_rows, fold, text_blocks

BUCKET_BITS = 16
BLOCK = 32
#: Bound of the training sample: rows per language, rows in all, words taken of one row.
ROWS_PER_LANG, MAX_ROWS, WORDS_PER_ROW = 300, 6000, 256
UNKNOWN = "und"


# ------------------------------------------------------------------ features


def _bucket(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ np.uint64(salt * 0x9E3779B1)) * np.uint64(0xFF51AFD7ED558CCD)
    return (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


def _byte_grams(w: Words, pos: np.ndarray) -> list[np.ndarray]:
    """Feature buckets at each letter byte: the bigram that ends and the trigram centred there."""
    a, b, c = (w.norm[pos + k].astype(np.uint64) for k in (-1, 0, 1))
    return [_bucket((a << np.uint64(8)) | b, 11), _bucket((a << np.uint64(16)) | (b << np.uint64(8)) | c, 12)]


def _word_features(w: Words) -> list[np.ndarray]:
    """Feature buckets of each word: identity, prefixes and suffixes."""
    out = [_bucket(w.hashes(), 1)]
    for k in (1, 2, 3, 4):
        out.append(_bucket(w.span_hash(w.start, np.minimum(w.start + k, w.end)), 1 + k))
        out.append(_bucket(w.span_hash(np.maximum(w.end - k, w.start), w.end), 5 + k))
    return out


def _letter_bytes(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all letter bytes, and where each word's run of them begins."""
    size = w.end - w.start
    first = np.cumsum(size) - size
    pos = np.arange(size.sum()) - np.repeat(first - w.start, size)
    return pos, first


def emissions(w: Words, weights: np.ndarray) -> np.ndarray:
    """Score of each language for each word; n-gram scores are averaged over the word."""
    if not len(w.start):
        return np.zeros((0, weights.shape[1]), np.float32)
    out = sum(weights[f] for f in _word_features(w))
    pos, first = _letter_bytes(w)
    g2, g3 = _byte_grams(w, pos)
    grams = weights[g2] + weights[g3]
    return out + np.add.reduceat(grams, first, axis=0) / (w.end - w.start)[:, None].astype(np.float32)


# ------------------------------------------------------- forward-backward


def marginals(em: np.ndarray, doc: np.ndarray, n_docs: int, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Posterior of each language at each word; ``doc`` is sorted, one chain per value."""
    n, k = em.shape
    if not n:
        return np.zeros((0, k))
    e = np.exp(em - em.max(1, keepdims=True)).astype(np.float64)
    a = np.exp(trans - trans.max())
    pi = np.exp(start - start.max())
    count = np.bincount(doc, minlength=n_docs)
    per = -(-count // BLOCK)  # blocks of each chain
    first_block = np.cumsum(per) - per
    first_word = np.cumsum(count) - count
    off = np.arange(n) - first_word[doc]
    blk, slot = first_block[doc] + off // BLOCK, off % BLOCK
    nb = int(per.sum())
    grid = np.ones((nb, BLOCK, k))
    grid[blk, slot] = e
    used = np.bincount(blk, minlength=nb)
    head = np.zeros(nb, bool)
    head[first_block[per > 0]] = True
    order = np.arange(nb) - np.repeat(first_block, per)  # number of the block in its chain

    # transfer matrix of each block: product over its words of A diag(e)
    m = np.broadcast_to(np.eye(k), (nb, k, k)).copy()
    for t in range(BLOCK):
        live = used > t
        if not live.any():
            break
        # a chain's first word is entered through pi, all others through A
        step = m[live].reshape(-1, k) @ a
        step = step.reshape(-1, k, k)
        if t == 0:
            h = head[live]
            step[h] = m[live][h]
        step *= grid[live, t][:, None, :]
        m[live] = step / step.sum((1, 2), keepdims=True)

    # chain the blocks: states entering each block from the left and from the right
    left = np.empty((nb, k))
    right = np.empty((nb, k))
    left[head] = pi / pi.sum()
    by_order = np.argsort(order, kind="stable")
    cuts = np.searchsorted(order[by_order], np.arange(order.max() + 2))
    for d in range(1, len(cuts) - 1):
        b = by_order[cuts[d] : cuts[d + 1]]
        v = np.einsum("nk,nkj->nj", left[b - 1], m[b - 1])
        left[b] = v / v.sum(1, keepdims=True)
    last = np.zeros(nb, bool)
    last[(first_block + per - 1)[per > 0]] = True
    right[last] = 1.0 / k
    for d in range(len(cuts) - 3, -1, -1):
        b = by_order[cuts[d] : cuts[d + 1]]
        b = b[~last[b]]
        v = np.einsum("nkj,nj->nk", m[b + 1], right[b + 1])
        right[b] = v / v.sum(1, keepdims=True)

    # inside the blocks
    fwd = np.empty((nb, BLOCK, k))
    cur = left
    for t in range(BLOCK):
        nxt = cur @ a if t else np.where(head[:, None], cur, cur @ a)
        nxt = nxt * grid[:, t]
        cur = np.where((used > t)[:, None], nxt / nxt.sum(1, keepdims=True), cur)
        fwd[:, t] = cur
    cur = right
    post = np.empty((nb, BLOCK, k))
    for t in range(BLOCK - 1, -1, -1):
        post[:, t] = fwd[:, t] * cur
        nxt = (cur * grid[:, t]) @ a.T
        cur = np.where((used > t)[:, None], nxt / nxt.sum(1, keepdims=True), cur)
    p = post[blk, slot]
    return p / p.sum(1, keepdims=True)


# ------------------------------------------------------------------ training


class CRF:
    """Learned weights: ``langs`` (sorted names), emissions, transitions, start scores."""

    def __init__(self, langs: list[str], weights: np.ndarray, trans: np.ndarray, start: np.ndarray):
        self.langs, self.weights, self.trans, self.start = langs, weights, trans, start

    def label_words(self, texts: list[str]) -> tuple[Words, np.ndarray]:
        """The words of the texts and the posterior of each language at each word."""
        w = Words(texts)
        return w, marginals(emissions(w, self.weights), w.doc, w.n_docs, self.trans, self.start)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language with the largest expected share of letters' words, and that share."""
        lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        todo = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if self.langs else []
        for lo, hi in text_blocks([texts[i] for i in todo], 1 << 20):
            ids = todo[lo:hi]
            w, p = self.label_words([texts[i] for i in ids])
            total = np.zeros((len(ids), len(self.langs)))
            for j in range(len(self.langs)):
                total[:, j] = np.bincount(w.doc, p[:, j], minlength=len(ids))
            share = total / np.maximum(total.sum(1, keepdims=True), 1e-300)
            best = share.argmax(1)
            for i, b, s in zip(ids, best, share.max(1), strict=True):
                lang[i], score[i] = self.langs[b], min(1.0, float(s))
        return lang, score


def _sequences(texts: list[str], labels: np.ndarray, rng: np.random.Generator, length: int):
    """Code-switched training sequences: spans of texts in random order, cut to ``length`` words."""
    w = Words(texts)
    n_doc = np.bincount(w.doc, minlength=w.n_docs)
    first = np.cumsum(n_doc) - n_doc
    spans = []
    for d in np.flatnonzero(n_doc):
        lo, hi = first[d], first[d] + n_doc[d]
        if hi - lo > WORDS_PER_ROW:  # a window of a long row, at a random place
            lo += rng.integers(0, hi - lo - WORDS_PER_ROW + 1)
            hi = lo + WORDS_PER_ROW
        while lo < hi:
            size = int(rng.integers(4, 49))
            spans.append(np.arange(lo, min(lo + size, hi)))
            lo += size
    order = np.concatenate([spans[i] for i in rng.permutation(len(spans))]) if spans else np.zeros(0, int)
    order = order[: len(order) // length * length] if len(order) >= length else order
    cut = order.reshape(-1, length) if len(order) >= length else order[None, :]
    return w, cut, labels[w.doc]


def train(texts: list[str], langs: list[str], seed: int = 7, epochs: int = 3, length: int = 64, batch: int = 64) -> CRF:
    names = sorted(set(langs))
    k = len(names)
    weights = np.zeros((1 << BUCKET_BITS, k), np.float32)
    trans, start = np.eye(k) * 1.0, np.zeros(k)
    if k < 2:
        return CRF(names, weights, trans, start)
    rng = np.random.default_rng(seed)
    y_doc = np.array([names.index(x) for x in langs])
    acc_w, acc_t = np.full(weights.shape, 1e-2, np.float32), np.full(trans.shape, 1e-2)
    for _ in range(epochs):
        w, cut, y = _sequences(texts, y_doc, rng, length)
        if not cut.size:
            break
        feats = np.stack(_word_features(w), 1)
        pos, first = _letter_bytes(w)
        g2, g3 = _byte_grams(w, pos)
        size = (w.end - w.start).astype(np.float32)
        for lo in range(0, len(cut), batch):
            seq = cut[lo : lo + batch]
            flat = seq.ravel()
            n_b, n_t = seq.shape
            reps = (w.end - w.start)[flat]
            at = np.repeat(first[flat] - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())
            owner = np.repeat(np.arange(len(flat)), reps)
            em = weights[feats[flat]].sum(1)
            gram = weights[g2[at]] + weights[g3[at]]
            em = em + np.add.reduceat(gram, np.cumsum(reps) - reps, axis=0) / size[flat][:, None]
            p, pair = _posteriors(em.reshape(n_b, n_t, k), trans, start)
            grad = p.reshape(-1, k)
            grad[np.arange(len(flat)), y[flat]] -= 1.0
            want = np.zeros((k, k))
            np.add.at(want, (y[seq[:, :-1]].ravel(), y[seq[:, 1:]].ravel()), 1.0)
            grad = (grad / n_b).astype(np.float32)
            full = np.zeros_like(weights)
            for f in range(feats.shape[1]):
                np.add.at(full, feats[flat, f], grad)
            share = grad[owner] / size[flat][owner][:, None]
            np.add.at(full, g2[at], share)
            np.add.at(full, g3[at], share)
            acc_w += full**2
            weights -= 0.3 * full / np.sqrt(acc_w)
            g_t = (pair - want) / n_b
            acc_t += g_t**2
            trans -= 0.1 * g_t / np.sqrt(acc_t)
    return CRF(names, weights, trans, start)


def _posteriors(em: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (B, T, K) and summed expected transitions (K, K) of equal-length chains."""
    e = np.exp(em - em.max(2, keepdims=True)).astype(np.float64)
    a = np.exp(trans - trans.max())
    n_b, n_t, k = e.shape
    f, b = np.empty_like(e), np.empty_like(e)
    cur = np.exp(start - start.max()) * e[:, 0]
    f[:, 0] = cur / cur.sum(1, keepdims=True)
    for t in range(1, n_t):
        cur = (f[:, t - 1] @ a) * e[:, t]
        f[:, t] = cur / cur.sum(1, keepdims=True)
    b[:, -1] = 1.0 / k
    for t in range(n_t - 2, -1, -1):
        cur = (b[:, t + 1] * e[:, t + 1]) @ a.T
        b[:, t] = cur / cur.sum(1, keepdims=True)
    p = f * b
    p /= p.sum(2, keepdims=True)
    pair = np.zeros((k, k))
    for t in range(n_t - 1):
        x = f[:, t, :, None] * a * (e[:, t + 1] * b[:, t + 1])[:, None, :]
        pair += (x / x.sum((1, 2), keepdims=True)).sum(0)
    return p, pair


# ------------------------------------------------------------------ Spark side


def training_rows(docs: DataFrame, may_train: Column, rows_per_lang: int = ROWS_PER_LANG, max_rows: int = MAX_ROWS) -> DataFrame:
    """At most ``rows_per_lang`` rows of each language and ``max_rows`` in all, by hash of
    the id.  Ids are chosen without reading a text; the few texts are fetched after.

    A language's row count gives a hash cut-off that about ``enough`` of its ids stay
    under, so the task that ranks a language reads as few rows of a large table as of a
    small one.  The first ``max_rows`` languages by name take part, one row of each at
    least; a repeated id stands for one document."""
    h = F.xxhash64("doc_id").alias("h")
    ids = docs.filter(may_train & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "lang", h)
    enough = rows_per_lang + 10 * rows_per_lang**0.5 + 50
    counts = ids.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("least")).orderBy("lang").limit(max_rows)
    under = F.when(F.col("n") > enough, (enough / F.col("n") * 2.0**64 - 2.0**63).cast("long")).otherwise(2**63 - 1)
    cuts = counts.select("lang", F.greatest("least", under).alias("cut"))
    ids = ids.join(F.broadcast(cuts), "lang").filter(F.col("h") <= F.col("cut")).select("doc_id", "lang", "h").distinct()
    by = Window.partitionBy("lang").orderBy("h", "doc_id")
    ids = ids.withColumn("rk", F.row_number().over(by)).filter(F.col("rk") <= rows_per_lang)
    ids = ids.orderBy("rk", "lang").limit(max_rows).select("doc_id").distinct()
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    return bounded_rows(ids, rows, max_rows, ["doc_id", "text", "lang"], _run_of_words)


def _run_of_words(text: str) -> str:
    """A sampled text for training; of a long one, a run of words at a place that its
    hash decides."""
    words = text.split()
    spare = len(words) - WORDS_PER_ROW
    at = zlib.crc32(text.encode("utf-8", "replace")) % (spare + 1) if spare > 0 else 0
    return text if spare <= 0 else " ".join(words[at : at + WORDS_PER_ROW])


def fit(docs: DataFrame, may_train: Column, **bounds: int) -> CRF:
    """Learn from text and lang of the rows for which ``may_train`` holds (a bounded
    sample: :data:`ROWS_PER_LANG`, :data:`MAX_ROWS`)."""
    got = training_rows(docs, may_train, **bounds).collect()
    got.sort(key=lambda r: (r["lang"], r["doc_id"], r["text"]))
    return train([r["text"] for r in got], [r["lang"] for r in got])


def predictor(model: CRF):
    """Pandas UDF: text -> struct(lang_pred, score); the model has a fixed size."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            lang, score = model.predict([t if isinstance(t, str) else None for t in s])
            yield pd.DataFrame({"lang_pred": lang, "score": score})

    return predict


def has_letter(text: str) -> Column:
    """Whether a text has a letter, as :meth:`CRF.predict` asks."""

    @F.pandas_udf("boolean")
    def letter(s: pd.Series) -> pd.Series:
        return s.map(lambda t: isinstance(t, str) and any(map(str.isalpha, t))).astype(bool)

    return letter(text)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id, 4) == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs`` (doc_id, text, lang)."""
    own = docs.select("doc_id", "text", "lang")
    model = fit(own, ~held_out(F.col("doc_id")))
    return (
        own.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predictor(model)("text").alias("p"))
        .select("doc_id", "held_out", "p.lang_pred", "p.score")
    )
