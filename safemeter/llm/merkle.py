"""Merkle manifest of a dataset: one tree per group and one over the groups, stored by blocks in van Emde Boas order.

Leaves of a group ascend by a key; every ``FANOUT`` consecutive nodes become their digest
until one is left.  The trees are stored as aligned subtrees of ``HEIGHT`` levels, each one
row whose nodes lie in van Emde Boas order: the upper half of the levels first, then the
subtrees below it one after another, each laid out the same way.  Addresses are arithmetic
(:func:`address`).  A block is built in a task from its leaves; the block roots are the
leaves of the next blocks, and so on up to the root, so that a group may hold any number of
leaves.  Proofs come down the same way: each block adds its siblings to what lies above.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, crc32_sql, ranked, skew_join, whole_groups

FANOUT = 8
#: Levels of edges in a block: 512 leaves, 585 nodes, 19 kB.
HEIGHT = 3
_LEAVES = FANOUT**HEIGHT
#: Blocks are handled in tasks in runs of about so many leaves.
_RUN = 1 << 14
_SIZE = 32


def nodes_in(levels: int) -> int:
    return (FANOUT**levels - 1) // (FANOUT - 1)


def address(depth: int, index: np.ndarray, levels: int) -> np.ndarray:
    """Places, in van Emde Boas order, of the nodes ``index`` of a depth in a tree of so many levels of nodes."""
    if levels == 1:
        return np.zeros_like(index)
    upper = levels // 2
    if depth < upper:
        return address(depth, index, upper)
    below = FANOUT ** (depth - upper)
    inner = address(depth - upper, index % below, levels - upper)
    return nodes_in(upper) + index // below * nodes_in(levels - upper) + inner


def height_of(leaves: int) -> int:
    """Levels of edges over so many leaves."""
    h = 0
    while FANOUT**h < leaves:
        h += 1
    return h


def node(children: bytes) -> bytes:
    """Digest of the children's hexadecimal digests, which follow one another."""
    return hashlib.sha256(children).digest()


def built(leaves: list[bytes], height: int) -> bytes:
    """The block over ``leaves``: ``height`` levels above them, a last run of fewer included, in van Emde Boas order."""
    out = np.zeros((nodes_in(height + 1), _SIZE), np.uint8)
    level = b"".join(leaves)
    for depth in range(height, -1, -1):
        rows = np.frombuffer(level, np.uint8).reshape(-1, _SIZE)
        out[address(depth, np.arange(len(rows)), height + 1)] = rows
        hexed, run = level.hex().encode(), FANOUT * 2 * _SIZE
        level = b"".join(node(hexed[k : k + run]) for k in range(0, len(hexed), run))
    return out.tobytes()


class Block:
    """A stored block; the runs of siblings are looked up by address."""

    def __init__(self, stored: bytes, leaves: int, height: int):
        table = np.frombuffer(stored, np.uint8).reshape(-1, _SIZE)
        self.height, self.levels, n = height, [], leaves  # hexadecimal digests of each level, leaves first
        for up in range(height + 1):
            self.levels.append(table[address(height - up, np.arange(n), height + 1)].tobytes().hex().encode())
            n = -(-n // FANOUT)

    def siblings(self, leaf: int, up: int = 0) -> list[tuple[bytes, bytes]]:
        """Digests of the run left and right of the leaf's ancestor ``up`` levels above it, and so on to the block's root."""
        out, at, wide = [], leaf // FANOUT**up, 2 * _SIZE
        for level in self.levels[up : self.height]:
            first = at // FANOUT * FANOUT
            out.append((level[first * wide : at * wide], level[(at + 1) * wide : (first + FANOUT) * wide]))
            at //= FANOUT
        return out


def packed(path: list[tuple[bytes, bytes]]) -> bytes:
    """Siblings level by level as one value: the numbers of digests left and right, then the digests."""
    return b"".join(bytes([len(a) // 64, len(b) // 64]) + bytes.fromhex((a + b).decode()) for a, b in path)


def unpacked(value: bytes) -> list[tuple[bytes, bytes]]:
    out, k = [], 0
    while k < len(value):
        a, b = value[k], value[k + 1]
        hexed = value[k + 2 : k + 2 + _SIZE * (a + b)].hex().encode()
        out.append((hexed[: 64 * a], hexed[64 * a :]))
        k += 2 + _SIZE * (a + b)
    return out


def folded(leaf: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """The root (hexadecimal) that a leaf (hexadecimal) and its siblings give."""
    for a, b in path:
        leaf = hashlib.sha256(a + leaf + b).hexdigest().encode()
    return leaf


def leaf_digest(*values: Column) -> Column:
    """SHA-256 (binary) of the values one after another: ``-`` for null, else the bytes of the value as text, ``:``, the text."""
    fields = [F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string"))) for v in values]
    return F.unhex(F.sha2(F.concat(*fields), 256))


_BLOCK = "g long, n long, block long, leaves int, nodes binary"


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks from entries (g, block, place, n, leaf) in order."""
    for t in whole_groups(batches, 2, _RUN):
        g, block, n = (t.column(c).to_numpy() for c in ("g", "block", "n"))
        leaf = t.column("leaf").to_pylist()
        cut = np.flatnonzero((np.diff(g, prepend=g[0] - 1) != 0) | (np.diff(block, prepend=-1) != 0))
        ends = np.append(cut[1:], len(g))
        nodes = [built(leaf[a:b], HEIGHT if n[a] > _LEAVES else height_of(int(n[a]))) for a, b in zip(cut, ends, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(g[cut]), pa.array(n[cut]), pa.array(block[cut]), pa.array((ends - cut).astype(np.int32)), pa.array(nodes, pa.binary())], ["g", "n", "block", "leaves", "nodes"])


def _blocks(entries: DataFrame) -> DataFrame:
    """Blocks over ``entries``: ``g``, ``n`` (leaves of the group), ``index``, ``leaf``."""
    dealt = entries.select("g", F.floor(F.col("index") / _LEAVES).alias("block"), (F.col("index") % _LEAVES).cast("int").alias("place"), "n", "leaf")
    return dealt.repartition("g", "block").sortWithinPartitions("g", "block", "place").mapInArrow(_build, _BLOCK)


def _root() -> Column:
    return F.substring("nodes", 1, _SIZE)  # the root's address is 0


def _trees(entries: DataFrame, longest: int, scratch: Scratch, label: str) -> tuple[list[DataFrame], DataFrame]:
    """Tables of blocks from the leaves up, and ``g``, ``root`` of each group."""
    levels, roots = [], []
    while True:
        blocks = scratch.written(_blocks(entries), f"{label}{len(levels)}")
        levels.append(blocks)
        roots.append(blocks.where(F.col("n") <= _LEAVES).select("g", _root().alias("root")))
        if longest <= _LEAVES:
            return levels, reduce(DataFrame.unionByName, roots)
        longest = -(-longest // _LEAVES)
        entries = blocks.where(F.col("n") > _LEAVES).select("g", F.ceil(F.col("n") / _LEAVES).alias("n"), F.col("block").alias("index"), _root().alias("leaf"))


@dataclass
class Manifest:
    """``leaves``: g, n, index, leaf and the caller's columns.  ``trees``: blocks of the groups' trees from the leaves up; ``top``: of the tree over the subroots.

    ``subroots``: g, root; ``root``: hexadecimal, None without leaves.
    """

    leaves: DataFrame
    trees: list[DataFrame]
    subroots: DataFrame
    top: list[DataFrame]
    root: str | None


def manifest(leaves: DataFrame, group: str, order: list[str], scratch: Scratch) -> Manifest:
    """``leaves``: rows with ``leaf`` (binary digest), a group (null is one, the first) and the columns to order by, nulls first.

    Rows that tie are in order of their digests.  A group may hold nearly all rows or one;
    there may be any number of groups.
    """
    key = F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    rows = ranked(leaves.withColumn("group_key", key), ["group_key", *order, "leaf"], scratch, "ranked")
    groups = scratch.written(rows.groupBy("group_key").agg(F.min("i").alias("base"), F.count("*").alias("n")), "groups")
    groups = scratch.written(ranked(groups, ["group_key"], scratch, "ranked-groups", "g"), "numbered-groups")
    placed = skew_join(rows, groups.select("group_key", "base", "g", "n"), "group_key", groups.select("group_key", "n"))
    placed = scratch.written(placed.withColumn("index", F.col("i") - F.col("base")).drop("i", "base", "group_key"), "leaves")
    count, longest = groups.agg(F.count("*"), F.max("n")).first()
    trees, subroots = _trees(placed, longest or 0, scratch, "tree")
    subroots = scratch.written(subroots, "subroots")
    top, root = _trees(subroots.select(F.lit(0).cast("long").alias("g"), F.lit(count).cast("long").alias("n"), F.col("g").alias("index"), F.col("root").alias("leaf")), count, scratch, "top")
    found = root.select(F.lower(F.hex("root"))).first()
    return Manifest(placed, trees, subroots, top, found and found[0])


def _downward(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """``g``, ``index`` and path of each leaf of ``blocks``; ``above``: the path of each block."""

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                n, whole = r["leaves"], r["n"]
                block = Block(r["nodes"], n, HEIGHT if whole > _LEAVES else height_of(whole))
                paths = [packed(block.siblings(k)) + r["path"] for k in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([r["g"]] * n, pa.int64()), pa.array([r["block"] * _LEAVES + k for k in range(n)], pa.int64()), pa.array(paths, pa.binary())], ["g", "index", "path"])

    return blocks.join(above, ["g", "block"]).mapInArrow(down, "g long, index long, path binary")


def _paths(levels: list[DataFrame], above: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """Path of each block of the lowest level; ``above``: the path of each group (``g``, ``path``)."""
    paths = None
    for k in reversed(range(len(levels))):
        tops = levels[k].where(F.col("n") <= _LEAVES).select("g", "block").join(above, "g")
        here = tops if paths is None else paths.select("g", F.col("index").alias("block"), "path").unionByName(tops)
        here = scratch.written(here, f"{label}-paths{k}")
        paths = _downward(levels[k], here) if k else here
    return paths


def proofs(m: Manifest, columns: list[str], scratch: Scratch, *, claimed: str = "claimed") -> DataFrame:
    """``columns`` of each leaf with its ``leaf``, ``subroot``, ``root``, ``proof_sha256`` and ``folded_root`` in hexadecimal.

    ``folded_root`` is folded from the digest in column ``claimed`` where that is not null,
    else from the leaf, with the siblings that are stored.  ``proof_sha256``: of all siblings.
    """
    schema = m.leaves.select(*columns).schema
    count = m.subroots.count()
    start = m.top[-1].where(F.col("n") <= _LEAVES).select("g", F.lit(b"").cast("binary").alias("path"))
    up = _downward(m.top[0], _paths(m.top, start, scratch, "top")).select(F.col("index").alias("g"), "path") if count > 1 else m.subroots.select("g", F.lit(b"").cast("binary").alias("path"))
    up = scratch.written(up, "group-paths")
    heads = m.trees[0].join(_paths(m.trees, up, scratch, "tree"), ["g", "block"])
    # a block's row comes before its leaves
    plain = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
    heads = heads.join(m.subroots.select("g", F.col("root").alias("subroot")), "g") if count > 1_000_000 else heads.join(F.broadcast(m.subroots.select("g", F.col("root").alias("subroot"))), "g")
    heads = heads.select("g", "block", F.lit(-1).alias("place"), "n", "leaves", "nodes", "path", "subroot", F.lit(None).cast("binary").alias("claimed"), *plain)
    none = [F.lit(None).cast(t).alias(c) for c, t in (("leaves", "int"), ("nodes", "binary"), ("path", "binary"), ("subroot", "binary"))]
    rows = m.leaves.select("g", F.floor(F.col("index") / _LEAVES).alias("block"), (F.col("index") % _LEAVES).cast("int").alias("place"), "n", *none, F.col(claimed).alias("claimed"), *columns)
    mixed = heads.unionByName(rows).repartition("g", "block").sortWithinPartitions("g", "block", "place")
    first = mixed.columns.index("claimed") + 1
    root = m.root

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = subroot = above = None
        runs: dict = {}
        for b in batches:
            keep, out = [], []
            col = {c: b.column(c).to_pylist() for c in ("place", "n", "leaves", "nodes", "path", "subroot", "claimed")}
            for k, place in enumerate(col["place"]):
                if place < 0:
                    n = col["n"][k]
                    block = Block(col["nodes"][k], col["leaves"][k], HEIGHT if n > _LEAVES else height_of(n))
                    subroot, above, runs = col["subroot"][k].hex(), unpacked(col["path"][k]), {}
                    continue
                own = block.siblings(place)
                if place // FANOUT not in runs:  # what the leaves of a run share
                    rest = own[1:] + above
                    runs[place // FANOUT] = rest, b"".join(a + z for a, z in rest), {}
                rest, suffix, known = runs[place // FANOUT]
                leaf = block.levels[0][64 * place : 64 * place + 64]
                first_up = folded(leaf if col["claimed"][k] is None else col["claimed"][k].hex().encode(), own[:1] if block.height else above)
                if block.height and first_up not in known:
                    known[first_up] = folded(first_up, rest)
                near = b"".join(a + z for a, z in own[:1])
                proof = hashlib.sha256(near + (suffix if block.height else b"".join(a + z for a, z in above))).hexdigest()
                keep.append(k)
                out.append((leaf.decode(), subroot, root, proof, (known[first_up] if block.height else first_up).decode()))
            if keep:
                kept = b.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([*(kept.column(k) for k in range(first, b.num_columns)), *(pa.array(x, pa.string()) for x in zip(*out, strict=True))], [*columns, *_PROVED])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return mixed.mapInArrow(prove, f"{fields}, " + ", ".join(f"{c} string" for c in _PROVED))


_PROVED = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def verified(docs: DataFrame, *, tampered: Column | None = None) -> DataFrame:
    """Every row of ``docs`` with leaf, subroot of its language, root, digest of its proof, the root
    folded from the leaf as it is now, and whether both roots agree.

    Leaves are over :data:`FIELDS`; other columns are not read.  ``tampered``: where it holds, the
    text has become lower case (A to Z) since.  Null values have a form of their own, a null
    language a tree of its own, and a null id comes first; repeated rows are leaves each, and
    rows that tie are in order of their digests.  Texts are read once and never shuffled.  No
    rows: no rows.  The result is written; all else that was written on the way is deleted.
    """
    spark = docs.sparkSession
    scratch, out = Scratch(spark, "merkle-steps"), Scratch(spark, "merkle")
    tampered = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))
    *others, text = (F.col(c) for c in FIELDS)
    lowered = F.translate(text.cast("string"), _UPPER, _UPPER.lower())
    rows = docs.select("doc_id", "lang", leaf_digest(*others, text).alias("leaf"), F.when(tampered, leaf_digest(*others, lowered)).alias("claimed"))
    m = manifest(rows, "lang", ["doc_id"], scratch)
    found = proofs(m, ["doc_id"], scratch)
    found = out.written(found.withColumn("verified", F.col("folded_root") == F.col("root")), "rows")
    scratch.drop()
    return found


def _verified_sql(group_levels: int, top_levels: int) -> str:
    """Plain level by level; so many levels hold ``8 ** group_levels`` documents a language and ``8 ** top_levels`` languages."""
    field = lambda c: f"case when {c} is null then '-' else strlen({c}::varchar) || ':' || {c}::varchar end"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in (*FIELDS[:-1], text)) + ")"
    lowered = f"translate(text, '{_UPPER}', '{_UPPER.lower()}')"
    sql = f"""
with l as (select doc_id, lang, {leaf("text")} as leaf, case when {crc32_sql("doc_id::varchar")} % 3 = 0 then {leaf(lowered)} end as claimed from documents),
r as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i from l),
s as (select lang as grp, i, leaf as h from r),
d0 as (select doc_id, lang, i as at, leaf, coalesce(claimed, leaf) as cur, '' as proof from r)"""

    def level(k: int, name: str, last: str, docs: str) -> str:
        return f""",
{name}{k} as (select grp, i // 8 as i, case when any_value(more) then sha256(string_agg(h, '' order by i)) else any_value(h) end as h from (select *, count(*) over (partition by grp) > 1 as more from {last}) group by grp, i // 8),
{name}m{k} as (select grp from {last} group by grp having count(*) > 1),
{docs}{k} as (
  select d.doc_id, d.lang, d.leaf, d.i0, d.grp, case when m.grp_more then d.at // 8 else d.at end as at,
    case when m.grp_more then sha256((select string_agg(case when s.i = d.at then d.cur else s.h end, '' order by s.i) from {last} s where s.grp is not distinct from d.grp and s.i // 8 = d.at // 8)) else d.cur end as cur,
    d.proof || case when m.grp_more then coalesce((select string_agg(s.h, '' order by s.i) from {last} s where s.grp is not distinct from d.grp and s.i // 8 = d.at // 8 and s.i <> d.at), '') else '' end as proof
  from {docs}{k - 1} d left join (select grp, true as grp_more from {name}m{k}) m on m.grp is not distinct from d.grp)"""

    sql = sql.replace("d0 as (select doc_id, lang, i as at,", "d0 as (select doc_id, lang, lang as grp, i as i0, i as at,")
    for k in range(1, group_levels + 1):
        sql += level(k, "s", "s" if k == 1 else f"s{k - 1}", "d")
    sql += f""",
t as (select 0 as grp, row_number() over (order by grp nulls first) - 1 as i, grp as lang, h from s{group_levels}),
e0 as (select d.doc_id, d.lang, d.leaf, d.i0, 0 as grp, t.i as at, d.cur, d.proof from d{group_levels} d join t on t.lang is not distinct from d.lang)"""
    for k in range(1, top_levels + 1):
        sql += level(k, "t", "t" if k == 1 else f"t{k - 1}", "e")
    return sql + f"""
select e.doc_id, e.leaf, t.h as subroot, x.h as root, sha256(e.proof) as proof_sha256, e.cur as folded_root, e.cur = x.h as verified
from e{top_levels} e join t on t.lang is not distinct from e.lang cross join t{top_levels} x
"""


VERIFIED_SQL = _verified_sql(6, 2)
