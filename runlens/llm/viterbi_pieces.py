"""SentencePiece encoding and decoding with a streaming Viterbi search.

A text is read character by character.  Arriving at a position, the best path to it is
taken over all pieces that end there (the sum of piece scores; of equal sums the longer
last piece).  Only positions within the longest piece's length can still be extended;
whenever the back-pointers of all of these meet in one boundary, the ids before it are
final, are committed, and the state before it is dropped.  Memory therefore follows the
longest piece, not the text.

White space is written as ``\\u2581`` with one in front of the text, as the vocabulary
expects; a character without a piece (and a literal ``\\u2581``) is written as its UTF-8
byte pieces, so decoding returns exactly the text.  The vocabulary is read once on the
driver from a path given as a parameter; it is never trained.

A text is split where no piece can span: before a white-space mark that follows another
character, if no piece crosses such a place, and around characters that occur in no
longer piece.  All paths meet there, so each part is searched on its own (the short parts of a block of
texts side by side, as arrays) and results of recent parts are reused.  Defined results: null and empty text -> no ids, restored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import text_blocks

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
REMEMBERED, SHORT, BLOCK_CHARS = 100_000, 32, 1 << 20
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class _Prefixes:
    """Hash table of all prefixes of pieces: number of the piece, or -1 for a mere prefix."""

    def __init__(self, pieces: dict[str, tuple[int, float]]):
        every = sorted({p[:i] for p in pieces for i in range(1, min(len(p), SHORT) + 1)})
        h = np.zeros(len(every), np.uint64)
        chars = _code_points(every)
        for k in range(chars.shape[1]):
            h = np.where(chars[:, k] > 0, self.extend(h, chars[:, k]), h)
        self.id = np.array([pieces[p][0] if p in pieces else -1 for p in every], np.int64)
        self.score = np.array([pieces[p][1] if p in pieces else -np.inf for p in every])
        self.bits = max(4, int(np.ceil(np.log2(len(every) + 1))) + 3)
        self.key, self.row = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int64)
        self.probes, todo = 0, np.arange(len(every))
        while len(todo):  # place what finds a free slot, try the rest one slot further
            at = self._slot(h[todo], self.probes)
            free = todo[self.row[at] < 0]
            at = self._slot(h[free], self.probes)
            self.row[at], self.key[at] = free, h[free]
            todo = np.setdiff1d(todo, self.row)
            self.probes += 1

    @staticmethod
    def extend(h: np.ndarray, c: np.ndarray) -> np.ndarray:
        return (h + c.astype(np.uint64)) * _BASE + np.uint64(1)

    def _slot(self, h: np.ndarray, probe: int) -> np.ndarray:
        x = h ^ (h >> np.uint64(31))
        return (((x * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64) + probe) & ((1 << self.bits) - 1)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Row of each hash, -1 if it is no prefix."""
        at = self._slot(h, 0)
        out = self.row[at]
        odd = np.flatnonzero((self.key[at] != h) & (out >= 0))  # another prefix's slot: look on
        out[odd] = -1
        for probe in range(1, self.probes):
            if not len(odd):
                break
            at = self._slot(h[odd], probe)
            row = self.row[at]
            same = self.key[at] == h[odd]
            out[odd[same]] = row[same]
            odd = odd[~same & (row >= 0)]
        return out


def _code_points(parts: list[str]) -> np.ndarray:
    width = max(map(len, parts), default=1)
    return np.array(parts, f"<U{width}").view(np.uint32).reshape(len(parts), width)


class Pieces:
    """Pieces with id and score, byte pieces, and where a text may be split."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int]):
        self.pieces, self.byte_ids = pieces, byte_ids
        self.longest = max(map(len, pieces), default=1)
        self.unknown = min((s for _, s in pieces.values()), default=0.0) - 10.0
        self.suffixes = {p[i:] for p in pieces for i in range(len(p))}
        self.text_of: dict[int, bytes] = {i: p.replace(MARK, " ").encode() for p, (i, _) in pieces.items()}
        self.text_of |= {i: bytes([b]) for b, i in enumerate(byte_ids)}
        joined = sorted({c for p in pieces if len(p) > 1 for c in p} - {MARK})
        inner = "".join(map(re.escape, joined))
        crossing = any(MARK in p.lstrip(MARK) for p in pieces)
        self.split = None if crossing or not inner else re.compile(f"{MARK}*[{inner}]+|{MARK}+|.", re.DOTALL)
        self.memory: dict[str, list[int]] = {}
        self._prefixes: _Prefixes | None = None

    def __getstate__(self):
        return self.pieces, self.byte_ids

    def __setstate__(self, state):
        self.__init__(*state)

    @staticmethod
    def load(path: str = MODEL) -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        usual = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        return Pieces({sp.id_to_piece(i): (i, sp.get_score(i)) for i in usual}, [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])

    # ------------------------------------------------------------ streaming search

    def stream(self, symbols: Iterable[str]) -> Iterator[int]:
        """Ids of a stream of symbols (characters; ``None`` marks a literal mark)."""
        pieces, longest = self.pieces, self.longest
        best, back, text = [0.0], [(-1, None)], ""
        for c in symbols:
            literal = c is None
            text += "\0" if literal else c
            n = len(text)
            top, frm = float("-inf"), (n - 1, None)
            if not literal:
                for size in self._sizes(text, n):
                    got = pieces.get(text[n - size :])
                    if got is not None and best[n - size] + got[1] > top:
                        top, frm = best[n - size] + got[1], (n - size, got[0])
            if frm[1] is None or top < best[n - 1] + self.unknown:
                raw = MARK if literal else c
                top, frm = best[n - 1] + self.unknown, (n - 1, raw)
            best.append(top)
            back.append(frm)
            if n >= 2 * longest:
                alive = set(range(n - longest + 1, n + 1))
                while len(alive) > 1:  # all back-pointers meet in one boundary
                    last = max(alive)
                    alive.discard(last)
                    alive.add(back[last][0])
                meet = alive.pop()
                if meet > 0:
                    yield from self._path(back, meet)
                    top = best[meet]
                    best = [b - top for b in best[meet:]]
                    back = [(-1, None)] + [(f - meet, i) for f, i in back[meet + 1 :]]
                    text = text[meet:]
        yield from self._path(back, len(text))

    def _sizes(self, text: str, n: int) -> list[int]:
        """Sizes of pieces that may end at ``n``, longest first."""
        out = []
        for size in range(1, min(self.longest, n) + 1):
            if text[n - size :] not in self.suffixes:
                break
            out.append(size)
        return out[::-1]

    def _path(self, back: list, end: int) -> list[int]:
        out: list[int] = []
        while end > 0:
            frm, what = back[end]
            out.extend(self.byte_ids[b] for b in reversed(what.encode())) if isinstance(what, str) else out.append(what)
            end = frm
        return out[::-1]

    # ------------------------------------------------------------------ texts

    def _search_parts(self, parts: list[str]) -> list[list[int]]:
        """Best paths of short parts, all at once: at each start position, the pieces that
        begin there are followed character by character through the prefix table."""
        if self._prefixes is None:
            self._prefixes = _Prefixes(self.pieces)
        table = self._prefixes
        chars = _code_points(parts).T.copy()
        width, n = chars.shape
        size = np.array([len(p) for p in parts])
        best = np.full((width + 1, n), -np.inf)
        best[0] = 0.0
        back, piece = np.zeros((width + 1, n), np.int32), np.full((width + 1, n), -1, np.int32)
        for start in range(width):
            live = np.flatnonzero(size > start)
            h, here = np.zeros(len(live), np.uint64), best[start][live]
            for end in range(start + 1, min(width, start + self.longest) + 1):
                h = table.extend(h, chars[end - 1][live])
                row = table.find(h)
                score = np.where(row >= 0, here + table.score[row], -np.inf)
                better = np.flatnonzero(score > best[end][live])
                at = live[better]
                best[end][at], back[end][at], piece[end][at] = score[better], start, table.id[row[better]]
                if end == start + 1:
                    worse = np.flatnonzero(here + self.unknown > best[end][live])
                    at = live[worse]
                    best[end][at], back[end][at], piece[end][at] = here[worse] + self.unknown, start, -1
                go = np.flatnonzero((row >= 0) & (size[live] > end))
                live, h, here = live[go], h[go], here[go]
                if not len(live):
                    break
        # walk back: step k from the end, written to the right edge of the path
        path = np.full((n, width), -2, np.int64)
        at, rows = size.copy(), np.arange(n)
        for k in range(width - 1, -1, -1):
            what = piece[at[rows], rows]
            path[rows, k] = np.where(what >= 0, what, -2 - at[rows])  # a character without a piece
            at[rows] = back[at[rows], rows]
            rows = rows[at[rows] > 0]
            if not len(rows):
                break
        used = path != -2
        flat, stop = path[used].tolist(), np.cumsum(used.sum(1)).tolist()
        out = [flat[a:b] for a, b in zip([0, *stop], stop, strict=False)]
        for i in np.flatnonzero((path < -2).any(1)).tolist():
            out[i] = [x for v in out[i] for x in ([v] if v >= 0 else (self.byte_ids[c] for c in parts[i][-3 - v].encode()))]
        return out

    def encode_all(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text."""
        memory = self.memory
        cut: list[list[str] | None] = []
        for t in texts:
            if not t or self.split is None or MARK in t:
                cut.append(None)
            else:
                cut.append(self.split.findall(MARK + t.replace(" ", MARK)))
        new = list(dict.fromkeys(p for parts in cut if parts for p in parts if p not in memory))
        if len(memory) + len(new) > REMEMBERED:
            memory.clear()
            new = list(dict.fromkeys(p for parts in cut if parts for p in parts))
        todo = sorted((p for p in new if len(p) <= SHORT), key=len)
        for lo in range(0, len(todo), 32_768):
            part = todo[lo : lo + 32_768]
            memory.update(zip(part, self._search_parts(part), strict=True))
        memory.update((p, list(self.stream(p))) for p in new if len(p) > SHORT)
        out = []
        for t, parts in zip(texts, cut, strict=True):
            if parts is not None:
                out.append(list(chain.from_iterable(map(memory.__getitem__, parts))))
            else:
                out.append(list(self.stream(MARK if c == " " else None if c == MARK else c for c in " " + t)) if t else [])
        return out

    def encode(self, text: str | None) -> list[int]:
        return self.encode_all([text])[0]

    def decode(self, ids: Iterable[int]) -> str:
        text = b"".join(map(self.text_of.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


# ------------------------------------------------------------------ Spark side


def decoder(pieces: Pieces):
    """Pandas UDF: ids -> text (null ids: null)."""

    @F.pandas_udf("string")
    def decode(s: pd.Series) -> pd.Series:
        return s.map(lambda ids: None if ids is None else pieces.decode(ids))

    return decode


def encoded(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_ids, ids, restored (decoding gives the text back) of every row of ``docs``.

    The vocabulary has a fixed size and travels with the function; ids leave the worker in
    blocks of about ``BLOCK_CHARS`` characters, so its memory does not follow the batch."""
    pieces = Pieces.load(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc_id, texts = b.column(0), [t or "" for t in b.column(1).to_pylist()]
            for lo, hi in text_blocks(texts, BLOCK_CHARS):
                ids = [np.array(i, np.int32) for i in pieces.encode_all(texts[lo:hi])]
                same = [pieces.decode(i.tolist()) == t for i, t in zip(ids, texts[lo:hi], strict=True)]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int64).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                columns = [doc_id.slice(lo, hi - lo), pa.array(np.diff(ends).astype(np.int64)), lists, pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_ids", "ids", "restored"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_ids long, ids array<int>, restored boolean")
