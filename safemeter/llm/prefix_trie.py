"""Prefix trie of conversations, and totals over its subtrees by centroid decomposition.

A node is a distinct sequence of first turns; it is named by its depth and its smallest
member, because a conversation passes one node of each depth.  Sequences are told apart by
chained SHA-256 digests of their turns, taken in chunks, so that no conversation has to fit
one task.

Totals over subtrees come from centroid decomposition of the parent edges.  The weight of a
node is the number of conversations through it, so the weight of a whole subtree, the turns
of its members from there on, is one plain aggregate and needs no totals itself.  A
component's centroid is its deepest node below which, itself included, lies more than half
of the component's weight.  The centroid's total is its own value and the totals of the
components below it; it is added to each node on the path from the centroid to the top of
the component.  The centroid goes, and the parts below and above it, each of half the weight
at most, are components of their own.  Components of more than ``local_nodes`` nodes are
split by joins, all of them in one round; smaller ones in the tasks, many at a time.  So the
number of rounds is logarithmic, however deep the trie is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, crc32_sql, ranked, skew_join, whole_groups

#: Turns of a conversation whose digests are chained in one group.
CHUNK = 1024
#: Nodes of a component that a task decomposes; larger ones are split by joins.
LOCAL_NODES = 8192
#: Components that are broadcast as rows of eleven numbers; more are joined by a shuffle.
BROADCAST_COMPONENTS = 500_000
#: Bytes of joined ids that travel as one row.
ID_BLOCK = 4096
WORD = r"[^\x20\x09-\x0D]+"
_START = bytes(32)


@dataclass
class Sequences:
    """``turns``: ``conv``, ``depth`` (from 1 without gaps), ``digest`` and ``words`` of each turn; ``convs``: ``conv`` and its ``length``."""

    turns: DataFrame
    convs: DataFrame


def rebuilt(conversations: DataFrame, scratch: Scratch, *, family: int = 20, most_shared: int = 4) -> Sequences:
    """Conversations that share their first turns with the head of their family.

    Conversation c gets the first h turns of conversation ``c - c % family`` (all if it has
    fewer, none if it is absent) in the place of its own first h, with h the CRC-32 of c in
    decimal modulo ``most_shared``.  Turns are in order of ``turn``, null first, ties by the
    digest of role and text.  Null roles and texts are empty; rows with a null ``conv_id``
    belong to no conversation.  A conversation may be of any length: places come from a
    range sort.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")
    )
    rows = ranked(rows, ["conv", "turn", "digest"], scratch, "ordered").drop("turn")
    head = F.col("conv") - F.col("conv") % family
    shared = F.crc32(F.col("conv").cast("string").cast("binary")) % most_shared
    own = scratch.written(rows.groupBy("conv").agg(F.min("i").alias("base"), F.count("*").alias("n")).withColumns({"head": head, "h": shared}), "own")
    heads = own.select(F.col("conv").alias("head"), F.col("n").alias("n_head"))
    taken = F.least("h", F.coalesce("n_head", F.lit(0)))
    convs = own.join(heads, "head", "left").select("conv", "head", "base", "n", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    convs = scratch.written(convs, "convs")
    placed = skew_join(rows, convs.select("conv", "base", "h", "taken", "length"), "conv", convs.select("conv", "n"))
    placed = scratch.written(placed.withColumn("p", F.col("i") - F.col("base")), "placed")
    kept = placed.where("p >= h").select("conv", (F.col("p") - F.col("h") + F.col("taken") + 1).alias("depth"), "digest", "words", "length")
    first = placed.where((F.col("conv") % family == 0) & (F.col("p") < most_shared - 1)).select(F.col("conv").alias("head"), "p", "digest", "words")
    lent = convs.join(first, "head").where("p < h").select("conv", (F.col("p") + 1).alias("depth"), "digest", "words", "length")
    return Sequences(kept.unionByName(lent), convs.select("conv", "length"))


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``digest`` of all rows of the chunk up to each row."""
    last, state = None, _START
    for b in batches:
        out = []
        for key, digest in zip(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True), b.column("digest").to_pylist(), strict=True):
            if key != last:
                last, state = key, _START
            state = hashlib.sha256(state + digest).digest()
            out.append(state)
        yield b.set_column(b.schema.get_field_index("digest"), "digest", pa.array(out, pa.binary()))


def _prefixes(turns: DataFrame, longest: int, chunk: int) -> DataFrame:
    """``turns`` with ``digest`` of all the sequence up to and with each turn; chunks in parallel, then chunks of chunks."""
    rows = turns.withColumn("chunk", F.floor((F.col("depth") - 1) / chunk))
    rows = rows.select("conv", "chunk", *(c for c in turns.columns if c != "conv"))
    rows = rows.repartition("conv", "chunk").sortWithinPartitions("conv", "chunk", "depth").mapInArrow(_chain, rows.schema)
    if longest <= chunk:
        return rows.drop("chunk")
    whole = rows.where(F.col("depth") % chunk == 0).select("conv", (F.col("depth") / chunk).cast("long").alias("depth"), "digest")
    before = _prefixes(whole, longest // chunk, chunk).select("conv", F.col("depth").alias("chunk"), F.col("digest").alias("before"))
    both = F.concat(F.coalesce("before", F.lit(_START)), F.col("digest"))
    return rows.join(before, ["conv", "chunk"], "left").withColumn("digest", F.unhex(F.sha2(both, 256))).drop("chunk", "before")


def _settled(node, depth, parent, top, weight, own, more) -> np.ndarray:
    """Totals over the subtrees of whole components, by centroid decomposition; one column of ``own`` per total.

    ``top``: the row of each row's component top.  ``more``: what earlier rounds added.
    """
    n = len(node)
    _, name = np.unique(np.concatenate([node, parent]), return_inverse=True)
    low, high = depth.min(), depth.max()
    key = name[:n] * (high - low + 2) + depth - low
    at = np.argsort(key)
    inner = np.flatnonzero(top != np.arange(n))
    up = np.full(n, -1)
    up[inner] = at[np.searchsorted(key[at], name[n:][inner] * (high - low + 2) + depth[inner] - 1 - low)]
    # places in preorder: sizes from the deepest level up, then starts from the top down
    order = np.argsort(depth, kind="stable")
    levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)
    size = np.ones(n, np.int64)
    for rows in reversed(levels):
        rows = rows[up[rows] >= 0]
        np.add.at(size, up[rows], size[rows])
    siblings = np.argsort(up, kind="stable")
    upto = np.cumsum(size[siblings])
    start = np.empty(n, np.int64)
    start[siblings] = upto - size[siblings]
    fresh = np.flatnonzero(np.diff(up[siblings], prepend=-2))
    start[siblings] -= np.repeat(upto[fresh] - size[siblings[fresh]], np.diff(np.append(fresh, n)))
    pre = start.copy()  # tops follow one another
    for rows in levels:
        rows = rows[up[rows] >= 0]
        pre[rows] = pre[up[rows]] + 1 + start[rows]
    end = pre + size

    total = np.zeros_like(own)
    weight, more = weight.copy(), more.copy()
    left = order  # rows that remain, by depth
    top = top.copy()
    while len(left):
        heavy = left[2 * weight[left] > weight[top[left]]]
        centroid = np.full(n, -1)
        centroid[top[heavy]] = heavy  # the last one written is the deepest
        mine = centroid[top[left]]
        below = (pre[left] > pre[mine]) & (pre[left] < end[mine])
        c = np.unique(mine)
        value = own.copy()
        np.add.at(value, mine[below], own[left[below]])
        value = value[c]
        total[c] = value + more[c]
        lost, high_end, now = weight[c], top[c], c
        while len(go := np.flatnonzero(now != high_end)):
            value, lost, high_end, now = value[go], lost[go], high_end[go], up[now[go]]
            more[now] += value
            weight[now] -= lost
        # each part below is named by the child of the centroid at its top
        kids = left[below][up[left[below]] == mine[below]]
        slot = np.argsort(c)
        of = lambda rows: slot[np.searchsorted(c, rows)] * (2 * n)
        code = of(up[kids]) + pre[kids]
        by = np.argsort(code)
        part = np.searchsorted(code[by], of(mine[below]) + pre[left[below]], side="right") - 1
        top[left[below]] = kids[by][part]
        left = left[left != mine]
    return total


_TOTALS = "node long, depth int, leaves long, saved long"


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Totals of all nodes of whole components, which follow one another."""
    for t in whole_groups(batches, 2, 1 << 16):
        col = {c: t.column(c).to_numpy() for c in t.column_names}
        new = (np.diff(col["top_node"], prepend=0) != 0) | (np.diff(col["top_depth"], prepend=0) != 0)
        new[0] = True
        of = np.cumsum(new) - 1
        is_top = np.flatnonzero((col["node"] == col["top_node"]) & (col["depth"] == col["top_depth"]))
        own, more = (np.stack([col[a], col[b]], axis=1) for a, b in (("leaves", "saved"), ("more_leaves", "more_saved")))
        found = _settled(col["node"], col["depth"].astype(np.int64), col["parent"], is_top[of], col["weight"], own, more)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (col["node"], col["depth"], found[:, 0], found[:, 1])], ["node", "depth", "leaves", "saved"])


_PART = ["top_node", "top_depth"]


def subtree_totals(nodes: DataFrame, members: DataFrame, scratch: Scratch, local_nodes: int = LOCAL_NODES) -> DataFrame:
    """``node``, ``depth`` and the sums of ``leaves`` and ``saved`` over the node's subtree.

    ``nodes``: written table of ``node``, ``depth``, ``parent`` (its own name at the root),
    ``weight`` of the subtree, ``leaves`` and ``saved``.  ``members``: written table with the
    node and its parent at each depth from 1 of each conversation.
    """
    state = ["node", "depth", "parent", "weight", "leaves", "saved", "more_leaves", "more_saved"]
    root = nodes.where("depth = 0").select("node").first()
    if root is None:
        return nodes.select("node", "depth", "leaves", "saved")
    zero = F.lit(0).cast("long")
    active = nodes.select(F.lit(root[0]).alias("top_node"), F.lit(0).alias("top_depth"), "node", "depth", "parent", "weight", "leaves", "saved", zero.alias("more_leaves"), zero.alias("more_saved"))
    small, done, k = [], [], 0
    while True:
        parts = active.groupBy(*_PART).agg(F.count("*").alias("n"), F.max("weight").alias("total"))
        large = scratch.written(parts.where(F.col("n") > local_nodes), f"large{k}")
        count = large.count()
        few = (lambda df: F.broadcast(df)) if count <= BROADCAST_COMPONENTS else (lambda df: df)
        if not count:
            small.append(active.select(*_PART, *state))
            break
        small.append(active.join(few(large.select(*_PART)), _PART, "left_anti").select(*_PART, *state))
        split = active.join(few(large), _PART)
        best = F.max_by(F.struct(*state), "depth").alias("c")
        cents = scratch.written(split.where("2 * weight > total").groupBy(*_PART).agg(best).select(*_PART, *(F.col(f"c.{c}").alias(f"c_{c}") for c in state)), f"centroids{k}")
        # conversations through a centroid, with the child that they pass
        under = members.join(few(cents.select(*_PART, "c_node", "c_depth")), (F.col("parent") == F.col("c_node")) & (F.col("depth") == F.col("c_depth") + 1))
        under = under.select(*_PART, F.col("node").alias("child"), F.col("conv").alias("node"))
        marked = split.join(few(cents.select(*_PART, "c_node", "c_depth")), _PART).where((F.col("node") != F.col("c_node")) | (F.col("depth") != F.col("c_depth")))
        marked = marked.join(under, ["node", *_PART], "left").withColumn("below", F.col("child").isNotNull() & (F.col("depth") > F.col("c_depth")))
        marked = scratch.written(marked.drop("n", "total"), f"marked{k}")
        sums = marked.where("below").groupBy(*_PART).agg(F.sum("leaves").alias("s_leaves"), F.sum("saved").alias("s_saved"))
        value = [(F.col(f"c_{c}") + F.coalesce(f"s_{c}", zero)).alias(f"v_{c}") for c in ("leaves", "saved")]
        valued = scratch.written(cents.join(few(sums), _PART, "left").select("*", *value), f"valued{k}")
        done.append(valued.select(F.col("c_node").alias("node"), F.col("c_depth").alias("depth"), *((F.col(f"v_{c}") + F.col(f"c_more_{c}")).alias(c) for c in ("leaves", "saved"))))
        # the path to the top: where the centroid's smallest member has been before
        gains = [F.col("v_leaves"), F.col("v_saved"), F.col("c_weight")]
        path = members.join(few(valued), (F.col("conv") == F.col("c_node")) & (F.col("depth") < F.col("c_depth")) & (F.col("depth") >= F.col("top_depth"))).select("node", "depth", *gains)
        path = path.unionByName(valued.where("top_depth = 0 and c_depth > 0").select(F.col("top_node").alias("node"), F.lit(0).alias("depth"), *gains))
        rest = marked.join(path, ["node", "depth"], "left")
        active = scratch.written(
            rest.select(
                F.when(F.col("below"), F.col("child")).otherwise(F.col("top_node")).alias("top_node"), F.when(F.col("below"), F.col("c_depth") + 1).otherwise(F.col("top_depth")).alias("top_depth"),
                "node", "depth", "parent", (F.col("weight") - F.coalesce("c_weight", zero)).alias("weight"), "leaves", "saved",
                (F.col("more_leaves") + F.coalesce("v_leaves", zero)).alias("more_leaves"), (F.col("more_saved") + F.coalesce("v_saved", zero)).alias("more_saved"),
            ),
            f"active{k}",
        )
        k += 1
    ready = reduce(DataFrame.unionByName, small)
    ready = ready.repartition(*_PART).sortWithinPartitions(*_PART)
    return reduce(DataFrame.unionByName, [ready.mapInArrow(_local, _TOTALS), *done])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of one node that follow one another, comma-joined, in blocks of about ``ID_BLOCK`` bytes."""
    key, first, ids, size, out = None, None, [], 0, []

    def close() -> None:
        if ids:
            out.append((*key, first, ",".join(ids)))

    for b in batches:
        for node, depth, conv in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
            if (node, depth) != key or size >= ID_BLOCK:
                close()
                key, first, ids, size = (node, depth), conv, [], 0
            ids.append(str(conv))
            size += len(ids[-1]) + 1
        if len(out) >= 1000:
            yield pa.RecordBatch.from_pylist([dict(zip(("node", "depth", "first", "ids"), x, strict=True)) for x in out], _BLOCK_SCHEMA)
            out.clear()
    close()
    if out:
        yield pa.RecordBatch.from_pylist([dict(zip(("node", "depth", "first", "ids"), x, strict=True)) for x in out], _BLOCK_SCHEMA)


_BLOCK_SCHEMA = pa.schema([("node", pa.int64()), ("depth", pa.int32()), ("first", pa.int64()), ("ids", pa.string())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per node over its blocks, which follow one another; only the running digest is held."""
    key, state = None, None
    for b in batches:
        out = []
        for node, depth, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
            if (node, depth) == key:
                state.update(b"," + ids.encode())
                continue
            if key is not None:
                out.append((*key, state.hexdigest()))
            key, state = (node, depth), hashlib.sha256(ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out])], ["node", "depth", "ends"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int32()), pa.array([state.hexdigest()])], ["node", "depth", "ends"])


def ends_of(enders: DataFrame) -> DataFrame:
    """``node``, ``depth`` and the SHA-256 of the ids in ascending order, comma-joined; any number of ids may share a node.

    A range sort deals the ids out and joins them to blocks; a hot node's digest reads blocks,
    not ids, one after another, as SHA-256 demands.
    """
    sort = ["node", "depth", "conv"]
    parts = int(enders.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = enders.select(*sort).repartitionByRange(parts, *sort).sortWithinPartitions(*sort).mapInArrow(_blocks, "node long, depth int, first long, ids string")
    return blocks.repartition("node", "depth").sortWithinPartitions("node", "depth", "first").mapInArrow(_digests, "node long, depth int, ends string")


def trie(sequences: Sequences, scratch: Scratch, *, chunk: int = CHUNK, local_nodes: int = LOCAL_NODES) -> DataFrame:
    """One row per node: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null at the
    root), ``n_convs``, ``n_children``, ``n_leaves`` and ``saved_tokens`` of the subtree, ``ends_sha256``.

    Conversations without turns are members of the root.  Equal conversations share all their
    nodes.  No conversation: no node.
    """
    longest = sequences.convs.agg(F.max("length")).first()[0]
    longest = 0 if longest is None else longest
    turns = sequences.turns.withColumn("depth", F.col("depth").cast("int"))
    turns = scratch.written(_prefixes(turns, longest, chunk), "sequences")
    found = turns.groupBy("digest").agg(F.min("conv").alias("node"), F.count("*").alias("n"), F.max("words").alias("words"), F.sum(F.col("length") - F.col("depth") + 1).alias("weight"))
    found = scratch.written(found, "found")
    named = skew_join(turns.select("conv", "depth", "digest", (F.col("depth") == F.col("length")).alias("last")), found.select("digest", "node", F.col("n").alias("n_convs"), "words", "weight"), "digest", found.select("digest", "n"))
    named = scratch.written(named.drop("digest"), "named")
    root = sequences.convs.agg(F.min("conv").alias("node"), F.count("*").alias("n_convs"), F.sum(F.col("length") + 1).alias("weight")).where("n_convs > 0")
    root_name = root.select("node").first()
    root_name = F.lit(root_name[0] if root_name else None).cast("long")
    up = named.select("conv", (F.col("depth") + 1).alias("depth"), F.col("node").alias("up"))
    members = named.join(up, ["conv", "depth"], "left").withColumn("parent", F.when(F.col("depth") == 1, root_name).otherwise(F.col("up"))).drop("up")
    members = scratch.written(members, "members")
    saved = (F.col("n_convs") - 1) * F.col("words")
    nodes = members.where("conv = node").select("node", "depth", "parent", "n_convs", "weight", saved.alias("saved"))
    nodes = nodes.unionByName(root.select("node", F.lit(0).alias("depth"), F.col("node").alias("parent"), "n_convs", "weight", F.lit(0).cast("long").alias("saved")))
    kids = members.where("conv = node").groupBy(F.col("parent").alias("node"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(kids, ["node", "depth"], "left").withColumns({"n_children": F.coalesce("n_children", F.lit(0).cast("long")), "leaves": F.col("n_children").isNull().cast("long")})
    nodes = scratch.written(nodes, "nodes")
    totals = subtree_totals(nodes, members.select("conv", "depth", "node", "parent"), scratch, local_nodes)
    turnless = sequences.convs.where("length = 0").select(root_name.alias("node"), F.lit(0).alias("depth"), "conv")
    ends = ends_of(members.where("last").select("node", "depth", "conv").unionByName(turnless))
    full = nodes.drop("leaves", "saved").join(totals, ["node", "depth"]).join(ends, ["node", "depth"], "left")
    return full.select(
        F.col("node").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.when(F.col("depth") > 0, F.col("parent")).alias("parent_conv_id"), "n_convs", "n_children",
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame, *, family: int = 20, most_shared: int = 4, chunk: int = CHUNK, local_nodes: int = LOCAL_NODES) -> DataFrame:
    """:func:`trie` over :func:`rebuilt` conversations; columns other than conv_id, turn, role and text are not read.

    Repeated rows are repeated turns; very long texts count once, as a digest.  The result is
    written; all else that was written on the way is deleted.
    """
    spark = conversations.sparkSession
    scratch, out = Scratch(spark, "trie-steps"), Scratch(spark, "trie")
    found = out.written(trie(rebuilt(conversations, scratch, family=family, most_shared=most_shared), scratch, chunk=chunk, local_nodes=local_nodes), "nodes")
    scratch.drop()
    return found


TRIE_SQL = rf"""
with t as (
  select conv_id as c, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as g, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) as w, turn
  from conversations where conv_id is not null),
own as (select c, g, w, row_number() over (partition by c order by turn nulls first, g) - 1 as p from t),
k as (select c, {crc32_sql("c::varchar")} % 4 as h from (select distinct c from t)),
u as (select c, p, g, w from own join k using (c) where p >= h union all select k.c, p, g, w from k join own o on o.c = k.c - k.c % 20 and p < h),
s as (select c, row_number() over (partition by c order by p) as d, g, w from u),
a as (select c, d, w, string_agg(g, '') over (partition by c order by d) as seq from s union all select c, 0, 0, '' from k),
size as (select c, max(d) as len from a group by c),
node as (select d, seq, min(c) as v, count(*) as n, max(w) as w, coalesce(string_agg(c::varchar, ',' order by c) filter (d = len), '') as ends from a join size using (c) group by d, seq),
m as (select c, d, v from a join node using (d, seq)),
n as (select node.*, m.v as parent from node left join m on m.c = node.v and m.d = node.d - 1),
kid as (select parent as v, d - 1 as d, count(*) as kids from n where d > 0 group by 1, 2),
f as (select n.*, coalesce(kids, 0) as kids from n left join kid using (v, d)),
total as (select m.v, m.d, sum((kids = 0)::int) as leaves, sum((n - 1) * w) as saved from f join m on m.c = f.v and m.d <= f.d group by 1, 2)
select v as conv_id, d as depth, parent as parent_conv_id, n as n_convs, kids as n_children, cast(leaves as bigint) as n_leaves, cast(saved as bigint) as saved_tokens, sha256(ends) as ends_sha256
from f join total using (v, d)
"""
