"""Merkle manifest of a dataset with resumable parent states.

Every row is a leaf.  The leaves of a source, in order of their id, are hashed in runs of
``FANOUT`` into parents, the parents likewise, until one node, the source's subroot, is
left; the subroots, in order of their source, give the root the same way.

A parent keeps a copy of its SHA-256 state as it stood before each child's slot.  Folding a
replaced leaf resumes that state with the replacement and hashes only the siblings to the
right; nothing to the left is read again.  Hash states cannot leave their process, so trees
are cut into storeys of ``STOREY`` levels: a block of ``FANOUT ** STOREY`` neighbouring nodes
is one group of a Spark job, and what stands above it reaches the block as one short path
(left and right siblings of each level).  Work per row is a few hashes a level; the largest
group is one block whatever the size of a source, and tables shrink by the block size from
storey to storey.  The driver sees the number of storeys and the root.

Defined results: a null id stands first and is never tampered with (it has no decimal form);
rows equal in source and id stand in order of their leaf; equal rows are leaves of their own;
a null source is a source, the first one; an empty table has no rows and no root.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import CRC_TABLE, crc32_sql, materialise
from runlens.operators.cells import ranked

FANOUT, STOREY = 16, 3
#: Hexadecimal digits of a digest.
HEX = 64
PATH = "array<struct<left:string,right:string>>"


class Parent:
    """A node with the hash states before the slots of its children."""

    __slots__ = ("states", "whole", "digest")

    def __init__(self, children: list[bytes]):
        self.whole, self.states, h = b"".join(children), [], sha256()
        for c in children:
            self.states.append(h.copy())
            h.update(c)
        self.digest = h.hexdigest().encode()

    def sides(self, slot: int) -> tuple[bytes, bytes]:
        """The siblings left and right of a slot."""
        return self.whole[: slot * HEX], self.whole[(slot + 1) * HEX :]

    def fold(self, slot: int, child: bytes) -> bytes:
        """This node's digest with another child in ``slot``."""
        h = self.states[slot].copy()
        h.update(child)
        h.update(self.whole[(slot + 1) * HEX :])
        return h.hexdigest().encode()


def levels_of(nodes: list[bytes], depth: int, fanout: int = FANOUT) -> list[list[Parent]]:
    """``depth`` levels of parents above neighbouring nodes, lowest first."""
    out = []
    for _ in range(depth):
        out.append([Parent(nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)])
        nodes = [p.digest for p in out[-1]]
    return out


def path_of(levels: list[list[Parent]], at: int, fanout: int = FANOUT) -> list[tuple[bytes, bytes]]:
    """Siblings of node ``at`` on every level."""
    out = []
    for parents in levels:
        out.append(parents[at // fanout].sides(at % fanout))
        at //= fanout
    return out


def fold_up(levels: list[list[Parent]], at: int, node: bytes, fanout: int = FANOUT) -> bytes:
    for parents in levels:
        node = parents[at // fanout].fold(at % fanout, node)
        at //= fanout
    return node


class Above:
    """What stands above a block: the states after the left siblings, and the right ones."""

    def __init__(self, path: list[dict]):
        sides = [(s["left"].encode(), s["right"].encode()) for s in path]
        self.steps = [(sha256(left), right) for left, right in sides]
        self.siblings = b"".join(left + right for left, right in sides)

    def fold(self, node: bytes) -> bytes:
        for state, right in self.steps:
            h = state.copy()
            h.update(node)
            h.update(right)
            node = h.hexdigest().encode()
        return node


# ------------------------------------------------------------------ Spark side


def field(c: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, ``:``, value."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(*columns: Column) -> Column:
    return F.sha2(F.concat(*map(field, columns)), 256)


def _block(fanout: int, storey: int) -> Column:
    return F.floor(F.col("pos") / F.lit(fanout**storey)).alias("block")


def _needed(n: int, fanout: int) -> int:
    """Levels that bring ``n`` nodes down to one."""
    out = 0
    while fanout**out < n:
        out += 1
    return out


def storeys(nodes: DataFrame, fanout: int = FANOUT, storey: int = STOREY) -> list[DataFrame]:
    """Tables of nodes (tree, pos, digest, depth), lowest first, the last with one node a
    tree.  From the second table on a node stands for a block of the table below, and
    ``depth`` is the number of levels inside that block: all of them where the tree has
    more blocks, else as many as bring it down to one node."""

    def roots(batch: pa.Table) -> pa.Table:
        t = batch.sort_by("pos")
        low = [d.encode() for d in t["digest"].to_pylist()]
        alone = _needed(len(low), fanout)
        levels = levels_of(low, storey, fanout)
        made = [low[0]] + [parents[0].digest for parents in levels]
        return pa.table({
            "tree": t["tree"][:1], "block": t["block"][:1], "alone": pa.array([alone], pa.int32()),
            "one": [made[alone].decode()], "full": [made[storey].decode()],
        })

    out, most = [nodes], 2
    while most > 1:
        blocks = out[-1].select("tree", "pos", "digest", _block(fanout, storey)).groupBy("tree", "block")
        blocks = materialise(blocks.applyInArrow(roots, "tree string, block long, alone int, one string, full string"), "merkle-blocks")
        sizes = blocks.groupBy(F.col("tree").alias("t")).agg(F.count(F.lit(1)).alias("n"))
        single = F.col("n") == 1
        sized = blocks.join(sizes, F.col("t") == F.col("tree")).select(
            "tree", F.col("block").alias("pos"), F.when(single, F.col("one")).otherwise(F.col("full")).alias("digest"),
            F.when(single, F.col("alone")).otherwise(F.lit(storey)).alias("depth"),
        )
        out.append(materialise(sized, "merkle-nodes"))
        most = sizes.agg(F.max("n")).first()[0] or 1
    return out


_SIDES = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
ABOVE = f"tree string, block long, depth int, path {PATH}, subroot string"


def _block_paths(nodes: pa.Table, blocks: pa.Table, fanout: int) -> tuple[pa.Table, pa.Array]:
    """The nodes of a block in order, and the path of each."""
    t, at = nodes.sort_by("pos"), blocks.slice(0, 1).to_pylist()[0]
    levels = levels_of([d.encode() for d in t["digest"].to_pylist()], at["depth"], fanout)
    own = ([{"left": a.decode(), "right": b.decode()} for a, b in path_of(levels, i, fanout)] for i in range(t.num_rows))
    return t, pa.array([p + at["path"] for p in own], _SIDES)


def paths(tables: list[DataFrame], trees: DataFrame, fanout: int = FANOUT, storey: int = STOREY) -> DataFrame:
    """The path of every block of the lowest table, from the path of every tree (tree, path, subroot)."""

    def widen(nodes: pa.Table, blocks: pa.Table) -> pa.Table:
        t, path = _block_paths(nodes, blocks, fanout)
        subroot = [blocks["subroot"][0].as_py()] * t.num_rows
        return pa.table({"tree": t["tree"], "block": t["pos"], "depth": t["depth"], "path": path, "subroot": pa.array(subroot, pa.string())})

    above = tables[-1].select("tree", F.col("pos").alias("block"), "depth").join(trees, "tree")
    above = materialise(above.select("tree", "block", "depth", "path", "subroot"), "merkle-paths")
    for table in reversed(tables[1:-1]):
        nodes = table.select("tree", "pos", "digest", "depth", _block(fanout, storey)).groupBy("tree", "block")
        above = materialise(nodes.cogroup(above.groupBy("tree", "block")).applyInArrow(widen, ABOVE), "merkle-paths")
    return above


def source_paths(subroots: DataFrame, fanout: int = FANOUT, storey: int = STOREY) -> tuple[DataFrame, str | None]:
    """The path of every subroot (tree, path, subroot) of ``subroots`` (tree, digest), and the root."""
    # trees are named "-" (null) or ":" and the source, so null stands first and the others in byte order
    nodes = ranked(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest"), ["tree"], ["source"], "pos")
    nodes = materialise(nodes, "merkle-subroots")
    tables = storeys(nodes, fanout, storey)
    root = tables[-1].first()
    top = tables[-1].select("tree", F.array().cast(PATH).alias("path"), F.lit("").alias("subroot"))

    def widen(nodes: pa.Table, blocks: pa.Table) -> pa.Table:
        t, path = _block_paths(nodes, blocks, fanout)
        return pa.table({"tree": t["source"], "path": path, "subroot": t["digest"]})

    above = paths(tables, top, fanout, storey)
    nodes = nodes.select("tree", "pos", "digest", "source", _block(fanout, storey)).groupBy("tree", "block")
    got = nodes.cogroup(above.groupBy("tree", "block")).applyInArrow(widen, f"tree string, path {PATH}, subroot string")
    return materialise(got, "merkle-sources"), root and root["digest"]


def proofs(docs: DataFrame, replaced: Column, fanout: int = FANOUT, storey: int = STOREY) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of ``docs``
    (doc_id, source, lang, n_chars, text).  ``replaced`` gives the text that the fold puts in
    place of a row's own, null where the row is left as it is."""
    own = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    kind = docs.schema["doc_id"].dataType.simpleString()
    leaves = docs.select(
        F.coalesce(F.concat(F.lit(":"), F.col("source")), F.lit("-")).alias("tree"), "source", "doc_id",
        leaf_digest(*own, F.col("text")).alias("digest"),
        F.when(replaced.isNotNull(), leaf_digest(*own, replaced)).alias("other"),
    )
    leaves = materialise(ranked(leaves, ["source"], ["doc_id", "digest"], "pos"), "merkle-leaves")
    tables = storeys(leaves, fanout, storey)
    trees, root = source_paths(tables[-1].select("tree", "digest"), fanout, storey)
    above = paths(tables, trees, fanout, storey)

    def fold(nodes: pa.Table, blocks: pa.Table) -> pa.Table:
        t, at = nodes.sort_by("pos"), blocks.slice(0, 1).to_pylist()[0]
        digests = [d.encode() for d in t["digest"].to_pylist()]
        others = [o and o.encode() for o in t["other"].to_pylist()]
        levels, up = levels_of(digests, at["depth"], fanout), Above(at["path"])
        proof, folded = [], []
        for i, (mine, other) in enumerate(zip(digests, others, strict=True)):
            h = sha256()
            for left, right in path_of(levels, i, fanout):
                h.update(left)
                h.update(right)
            h.update(up.siblings)
            proof.append(h.hexdigest())
            folded.append(up.fold(fold_up(levels, i, other or mine, fanout)).decode())
        subroot = [at["subroot"]] * len(digests)
        return pa.table({"doc_id": t["doc_id"], "leaf": t["digest"], "subroot": subroot, "proof_sha256": proof, "folded_root": folded})

    nodes = leaves.select("tree", "pos", "digest", "doc_id", "other", _block(fanout, storey)).groupBy("tree", "block")
    got = nodes.cogroup(above.groupBy("tree", "block")).applyInArrow(
        fold, f"doc_id {kind}, leaf string, subroot string, proof_sha256 string, folded_root string"
    )
    got = got.withColumn("root", F.lit(root).cast("string")).withColumn("verified", F.col("folded_root") == F.col("root"))
    return got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tampered_text() -> Column:
    """The text with A-Z lower-cased where 5 divides the unsigned crc32 of the decimal id."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return F.when(hit & F.col("text").isNotNull(), F.translate("text", UPPER, LOWER))


def manifest(docs: DataFrame) -> DataFrame:
    return proofs(docs.select("doc_id", "source", "lang", "n_chars", "text"), tampered_text())


def _oracle(levels: int = 6, tops: int = 3) -> str:
    """DuckDB SQL of the manifest for up to ``FANOUT ** levels`` rows a source and
    ``FANOUT ** tops`` sources, a CTE a level."""
    n, sql = FANOUT, []

    def tree(name: str, depth: int, key: str) -> None:
        for k in range(depth):
            sql.append(f"""{name}s{k} AS (
  SELECT *, coalesce(string_agg(d, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(d, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {name}{k} WHERE n > 1 WINDOW w AS (PARTITION BY {key}, p // {n} ORDER BY p))""")
            sql.append(f"""{name}{k + 1} AS (
  SELECT {key}, p // {n} AS p, (n + {n - 1}) // {n} AS n, CASE WHEN n > 1 THEN sha256(string_agg(d, '' ORDER BY p)) ELSE min(d) END AS d
  FROM {name}{k} GROUP BY {key}, p // {n}, n)""")

    value = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    low = f"translate(text, '{UPPER}', '{LOWER}')"
    head = " || ".join(map(value, ("doc_id", "source", "lang", "n_chars")))
    sql.append(CRC_TABLE)
    sql.append(f"""leaves AS (
  SELECT doc_id, coalesce(':' || source, '-') AS s, sha256({head} || {value("text")}) AS leaf,
         CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN sha256({head} || {value(low)}) END AS other
  FROM documents, crc_table)""")
    sql.append("""placed AS (
  SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY s) AS n FROM leaves)""")
    sql.append("a0 AS (SELECT s, p, n, leaf AS d FROM placed)")
    tree("a", levels, "s")
    sql.append(f"b0 AS (SELECT 0 AS z, s, row_number() OVER (ORDER BY encode(s)) - 1 AS p, count(*) OVER () AS n, d FROM a{levels})")
    tree("b", tops, "z")
    sql.append("f0 AS (SELECT doc_id, s, p, leaf, coalesce(other, leaf) AS f, '' AS proof FROM placed)")
    step = "CASE WHEN x.d IS NULL THEN f ELSE sha256(l || f || r) END AS f, proof || coalesce(l || r, '') AS proof"
    for k in range(levels):
        sql.append(f"f{k + 1} AS (SELECT doc_id, f.s, leaf, f.p // {n} AS p, {step} FROM f{k} f LEFT JOIN as{k} x ON x.s = f.s AND x.p = f.p)")
    sql.append(f"g0 AS (SELECT doc_id, leaf, d AS subroot, b0.p, f, proof FROM f{levels} f JOIN b0 ON b0.s = f.s)")
    for k in range(tops):
        sql.append(f"g{k + 1} AS (SELECT doc_id, leaf, subroot, f.p // {n} AS p, {step} FROM g{k} f LEFT JOIN bs{k} x ON x.p = f.p)")
    body = ",\n".join(sql)
    return f"""WITH {body}
SELECT doc_id, leaf, subroot, b{tops}.d AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = b{tops}.d AS verified
FROM g{tops}, b{tops}"""


ORACLE = _oracle()
