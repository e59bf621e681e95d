"""Shared helpers of the training-data operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.session import scratch_path

#: ASCII white space of the word definition ``[^\x20\x09-\x0D]+``.
SPACE = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once under the shared checkpoint folder and read it back: cuts the
    lineage, survives lost executors and gives later joins a true size estimate."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod`` (null for a null id)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % mod


#: Characters of one sampled text that training reads at most.
SAMPLE_CHARS = 16_384


def shortened(text: str, most: int = SAMPLE_CHARS) -> str:
    """A sampled text of at most ``most`` characters: of a longer one, evenly spaced pieces
    (a text without white space is one long word and is cut the same way)."""
    if len(text) <= most:
        return text
    pieces = 16
    size = most // pieces - 1
    return " ".join(text[at : at + size] for at in np.linspace(0, len(text) - size, pieces).astype(int).tolist())


def bounded_rows(ids: DataFrame, docs: DataFrame, bound: int, keep: list[str], thin) -> DataFrame:
    """The rows of ``docs`` whose ``doc_id`` stands in the bounded table ``ids``, each text
    thinned to a bounded size (``thin``, then :func:`shortened`) where it lies.

    ``ids`` holds at most ``bound`` rows, so it is broadcast; repeated ids cannot make
    the sample larger than ``bound`` rows (a top-k by hash of thinned rows)."""
    cut = F.pandas_udf(lambda s: s.map(lambda t: shortened(thin(t))), "string")
    got = docs.join(F.broadcast(ids), "doc_id").withColumn("text", cut("text")).select(*keep)
    return got.orderBy(F.xxhash64("doc_id"), F.xxhash64("text")).limit(bound)


def unused(docs: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``docs`` does not have (case aside)."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


# ---------------------------------------------------------------- words as bytes

_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[128:] = True

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_P, _P_INV)):
            seq = np.full(size, base, np.uint64)
            seq[0] = 1
            _powers[k] = np.cumprod(seq, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


class Words:
    """The letter runs of some texts, lower-cased, as offsets into one byte buffer.

    ``start``/``end`` bound each word, ``doc`` is its text's number, ``norm`` the bytes
    with everything but letters turned into a space.  All features are computed from
    these arrays, so no Python object is made per word."""

    def __init__(self, texts: list[str]):
        parts = [t.lower().encode("utf-8", "replace") for t in texts]
        buf = np.frombuffer(b" " + b"\n".join(parts) + b"\n ", np.uint8)
        letter = _LETTER[buf]
        edge = np.diff(letter.view(np.int8), prepend=np.int8(0))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.norm = np.where(letter, buf, np.uint8(32))
        stops = np.cumsum(np.array([len(p) + 1 for p in parts], np.int64)) + 1
        self.doc = np.searchsorted(stops, self.start, "right")
        self.n_docs = len(parts)
        pw, self._inv = _power_tables(len(buf) + 1)
        self._sum = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * pw[:-1], out=self._sum[1:])

    def span_hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of the bytes [a, b) wherever they stand."""
        return mix((self._sum[b] - self._sum[a]) * self._inv[a])

    def hashes(self) -> np.ndarray:
        return self.span_hash(self.start, self.end)


def text_blocks(texts: list[str], max_chars: int):
    """Index ranges of consecutive texts of about ``max_chars`` characters each."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > max_chars:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


# ------------------------------------------------------- CRC-32 in DuckDB SQL

#: CTE ``crc_table``: the 256 remainders of the reflected polynomial.
CRC_TABLE = """crc_table AS (
  SELECT list(list_reduce([n] || list_transform(range(8), lambda k: 0::BIGINT),
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t
  FROM (SELECT unnest(range(256)) AS n))"""


def crc32_sql(text: str) -> str:
    """DuckDB expression: unsigned crc32 of the UTF-8 bytes of a string expression (null for
    null); ``crc_table``, which has one row, stands beside the queried table."""
    code = f"CAST('0x' || substr(hex(encode({text})), 2 * k + 1, 2) AS BIGINT)"
    codes = f"list_transform(range(strlen({text})), lambda k: {code})"
    return f"xor(list_reduce([4294967295::BIGINT] || {codes}, lambda c, b: xor(c >> 8, crc_table.t[1 + (xor(c, b) & 255)])), 4294967295)"
