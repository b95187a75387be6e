"""SimHash near-duplicates: a binary trie of the fingerprints joined with itself.

The fingerprints' trie is walked in pairs of nodes at once.  A pair carries the bits in
which its two prefixes differ and is given up as soon as these exceed the budget.  The
top levels are walked in Spark, over counts of nodes: pairs within the budget that hold too
many fingerprints go down to their descendants, and a fingerprint goes to the pairs that
its prefixes are in.  Each pair of subtrees left is of bounded size and is walked to its leaves inside one task, in numpy, and yields a spanning
forest of its links, so dense clusters never emit all their pairs.  Connected components
come from alternating large-star and small-star rounds over those links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, by_id, fresh_name, ranked, skew_join, text_or_empty, written

WORDS = 3
BITS = 3
#: Fingerprints that a subtree should hold on average, and at most in both nodes of a pair that one task walks.
SUBTREE, MOST_IN_PAIR = 8192, 65536
#: The first level at which nodes are counted is this at least; pairs that hold too many go down so many levels at a time.
LEAST_LEVELS, STEP = 6, 4
#: Node pairs with no more pairs of fingerprints than this are compared outright.
LEAF_PAIRS = 48
_CHUNK = 1 << 16


# ---------------------------------------------------------------- fingerprints
def fingerprint(text: str | None, size: int = WORDS, seed: int = 42) -> int:
    """64-bit SimHash of ``size``-word shingles; a text without words has fingerprint 0."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(parts) > size:
        starts, ends = starts[: len(parts) - size + 1], ends[size - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], dtype="<u8")
    total = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        total += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(h), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, seed: int = 42) -> DataFrame:
    """``id_col`` and ``fingerprint`` (signed long) of every row; null text: fingerprint 0."""
    kind = docs.schema[id_col].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), size, seed) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], [id_col, "fingerprint"])

    narrow = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("t"))
    return narrow.mapInArrow(of, f"`{id_col}` {kind}, fingerprint long")


# ---------------------------------------------------------------- the walk inside a task
class Forest:
    """Connected sets of 0..n-1, each labelled by its smallest member."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.label[a], self.label[b]
            differ = x != y
            if not differ.any():
                return
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while (up := self.label[self.label]).tobytes() != self.label.tobytes():
                self.label = up


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts (2, 3): owners 0 0 1 1 1 and ranks 0 1 0 1 2."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def linked_pairs(left: np.ndarray, right: np.ndarray, level: int, spent: int, budget: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of sorted unsigned ``left`` and ``right`` within ``budget`` differing bits.

    All of ``left`` share their first ``level`` bits, and so do all of ``right``; these
    differ in ``spent`` bits.  ``same``: both sides are one node.
    """
    one = np.array
    todo = [(level, one([0]), one([len(left)]), one([0]), one([len(right)]), one([spent]), one([same]))]
    while todo:
        level, a0, a1, b0, b1, err, twin = todo.pop()
        if len(a0) > _CHUNK:
            h = len(a0) // 2
            todo += [(level, *(x[:h] for x in (a0, a1, b0, b1, err, twin))), (level, *(x[h:] for x in (a0, a1, b0, b1, err, twin)))]
            continue
        small = (a1 - a0) * (b1 - b0) <= LEAF_PAIRS
        if level == 64:
            small[:] = True
        if small.any():
            na, nb = (a1 - a0)[small], (b1 - b0)[small]
            pairs = na * nb
            for k in _slices(pairs):
                owner, rank = _spread(pairs[k])
                width = nb[k][owner]
                i, j = a0[small][k][owner] + rank // width, b0[small][k][owner] + rank % width
                near = np.bitwise_count(left[i] ^ right[j]) <= budget
                near &= ~(twin[small][k][owner] & (i >= j))
                if near.any():
                    yield i[near], j[near]
        go = ~small
        if not go.any():
            continue
        a0, a1, b0, b1, err, twin = (x[go] for x in (a0, a1, b0, b1, err, twin))
        bit = np.uint64(63 - level)
        am = _middle(left, a0, bit)
        bm = _middle(right, b0, bit)
        kids = [(a0, am, b0, bm, err, twin), (am, a1, bm, b1, err, twin), (a0, am, bm, b1, err + 1, np.zeros_like(twin)), (am, a1, b0, bm, err + 1, twin)]
        kept = []
        for k, (x0, x1, y0, y1, e, w) in enumerate(kids):
            keep = (x1 > x0) & (y1 > y0) & (e <= budget)
            if k == 3:  # of a node with itself, the two crossings are one
                keep &= ~w
                w = np.zeros_like(w)
            kept.append([v[keep] for v in (x0, x1, y0, y1, e, w)])
        todo.append((level + 1, *(np.concatenate(v) for v in zip(*kept, strict=True))))


def _slices(pairs: np.ndarray) -> Iterator[slice]:
    """Cuts of the node pairs into runs of a bounded number of fingerprint pairs."""
    block = np.cumsum(pairs) // (1 << 18)
    edges = np.flatnonzero(np.diff(block)) + 1
    bounds = [0, *edges.tolist(), len(pairs)]
    yield from (slice(a, b) for a, b in zip(bounds, bounds[1:], strict=False) if b > a)


def _middle(values: np.ndarray, first: np.ndarray, bit: np.uint64) -> np.ndarray:
    """Where, in the node that starts at ``first``, the values with ``bit`` set begin."""
    above = bit + np.uint64(1)
    prefix = (values[first] >> above) << above if above < 64 else np.zeros(len(first), np.uint64)
    return np.searchsorted(values, prefix | (np.uint64(1) << bit))


def forest_of_pair(fps: np.ndarray, level: int, budget: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest among the fingerprints of one pair of nodes at depth ``level``."""
    values = np.unique(fps)
    forest = Forest(len(values))
    if same:
        found, shift = linked_pairs(values, values, level, 0, budget, True), 0
    else:
        top = values >> np.uint64(64 - level) if level < 64 else values
        shift = int(np.searchsorted(top, top[-1]))
        found = linked_pairs(values[:shift], values[shift:], level, int(np.bitwise_count(top[0] ^ top[-1])), budget, False)
    for i, j in found:
        forest.link(i, j + shift)
    other = np.flatnonzero(forest.label != np.arange(len(values)))
    return values[other], values[forest.label[other]]


def _node(level: int):
    """The first ``level`` bits of a fingerprint."""
    return F.shiftrightunsigned("fingerprint", 64 - level) if level < 64 else F.col("fingerprint")


def _sizes(fingerprints: DataFrame, level: int) -> DataFrame:
    return fingerprints.groupBy(_node(level).alias("node")).agg(F.count("*").alias("n"))


def node_pairs(fingerprints: DataFrame, budget: int, scratch: Scratch) -> list[tuple[int, DataFrame]]:
    """(level, pairs of nodes ``a`` <= ``b`` of the trie): together they hold every two fingerprints within the budget.

    Only nodes that hold fingerprints are paired, and only within the budget of differing
    bits.  A pair of more than ``MOST_IN_PAIR`` fingerprints is replaced by the pairs of its
    nodes' descendants, down to single fingerprints if need be.
    """
    level = min(64, max(LEAST_LEVELS, (max(1, fingerprints.count()) // SUBTREE).bit_length()))
    masks = [sum(1 << b for b in c) for k in range(budget + 1) for c in combinations(range(level), k)]
    nodes = scratch.written(_sizes(fingerprints, level), "nodes")
    a = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.explode(F.array(*map(F.lit, masks))).alias("mask"))
    a = a.withColumn("b", F.col("a").bitwiseXOR(F.col("mask"))).where("a <= b").drop("mask")
    pairs = a.join(nodes.toDF("b", "nb"), "b").select("a", "b", "na", "nb")
    found = []
    while True:
        pairs = scratch.written(pairs, f"pairs-{level}")
        crowd = F.when(F.col("a") == F.col("b"), F.col("na")).otherwise(F.col("na") + F.col("nb")) > MOST_IN_PAIR
        found.append((level, pairs.where(~crowd).select("a", "b")))
        crowded = pairs.where(crowd).select("a", "b")
        if level == 64 or crowded.isEmpty():
            return found
        step = min(STEP, 64 - level)
        level += step
        parents = crowded.select(F.col("a").alias("parent")).unionByName(crowded.select(F.col("b").alias("parent"))).distinct()
        within = fingerprints.withColumn("parent", _node(level - step)).join(parents, "parent", "left_semi")
        kids = scratch.written(_sizes(within, level).withColumn("parent", F.shiftrightunsigned("node", step)), f"nodes-{level}")
        pairs = crowded.join(kids.toDF("ka", "na", "a"), "a").join(kids.toDF("kb", "nb", "b"), "b")
        near = F.bit_count(F.col("ka").bitwiseXOR(F.col("kb"))) <= budget
        pairs = pairs.where(near & (F.when(F.col("a") == F.col("b"), F.col("ka") <= F.col("kb")).otherwise(True))).select(F.col("ka").alias("a"), F.col("kb").alias("b"), "na", "nb")


def links(fingerprints: DataFrame, *, budget: int = BITS) -> DataFrame:
    """Links ``a``, ``b`` between distinct fingerprints whose closure is that of all pairs within ``budget`` bits.

    ``fingerprints``: one column ``fingerprint`` of distinct longs.
    """
    scratch = Scratch(fingerprints.sparkSession, "trie")
    to = None
    for level, pairs in node_pairs(fingerprints, budget, scratch):
        ends = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("node"))
        part = fingerprints.withColumn("node", _node(level)).join(ends, "node").select(F.lit(level).alias("level"), "a", "b", "fingerprint")
        to = part if to is None else to.unionByName(part)

    def walk(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        level, a, b = map(int, key)
        x, y = forest_of_pair(group["fingerprint"].to_numpy().view(np.uint64), level, budget, a == b)
        return pd.DataFrame({"a": x.view(np.int64), "b": y.view(np.int64)})

    out = scratch.written(to.groupBy("level", "a", "b").applyInPandas(walk, "a long, b long").distinct(), "links")
    for name in scratch.names - {"links"}:
        scratch.drop(name)
    return out


# ---------------------------------------------------------------- components
def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``node``, ``root`` (smallest node reachable) for every node of ``edges`` (columns a, b, both long).

    Alternates large-star and small-star until the links no longer change; every round
    is written, so a lost executor never sends the work back to the first round, and the
    round before is deleted.
    """
    scratch, turn, state = scratch or Scratch(edges.sparkSession, "components"), 0, None
    links = scratch.written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links-0")
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"near-{turn}")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.written(large, f"large-{turn}")
        least = scratch.written(large.groupBy("u").agg(F.min("v").alias("m")), f"least-{turn}")
        joined = large.join(least, "u")
        links = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        links = scratch.written(links, f"links-{turn + 1}")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        for name in (f"links-{turn}", f"near-{turn}", f"large-{turn}", f"least-{turn}"):
            scratch.drop(name)
        turn += 1
        if now == state:
            break
        state = now
    roots = links.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


# ---------------------------------------------------------------- the operator
def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, budget: int = BITS, seed: int = 42, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of ``docs``: id, ``fingerprint`` (long) and ``component_id``.

    component_id is the smallest id among the documents reachable over links of at most
    ``budget`` differing bits, the document itself included.  Null or blank text has
    fingerprint 0 and is linked like any other; a null id never becomes a component_id,
    so a component of null ids only has component_id null.  Repeated rows give repeated
    rows.  An empty table gives an empty result.  Other columns are not read.
    """
    scratch = scratch or Scratch(docs.sparkSession, "near-duplicates")
    rows = scratch.written(with_fingerprint(docs, id_col=id_col, text_col=text_col, size=size, seed=seed), "fingerprints")
    distinct = scratch.written(rows.groupBy("fingerprint").agg(F.min(id_col).alias("least_id"), F.count("*").alias("n")), "distinct")
    roots = components(links(distinct.select("fingerprint"), budget=budget))
    labelled = scratch.written(distinct.join(roots, distinct["fingerprint"] == roots["node"], "left").select("fingerprint", "least_id", F.coalesce("root", "fingerprint").alias("root")), "labelled")
    least = labelled.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of = scratch.written(labelled.select("fingerprint", "root").join(least, "root").select("fingerprint", "component_id"), "of")
    return skew_join(rows, of, "fingerprint", distinct).select(F.col(id_col), "fingerprint", "component_id")


# ---------------------------------------------------------------- by Jaccard similarity
#: Words of a shingle, and the least similarity of two texts, as a fraction.
SIMILAR_WORDS, SIMILAR = 5, (4, 5)
#: MinHash bands and rows: a pair of similarity 0.8 shares none of the bands with probability 0.0004.
BANDS, ROWS = 20, 5
#: Texts of a band that are compared with one another, or with as many others, in one task; shingles counted at a time.
BLOCK_ROWS, _COLUMNS = 512, 2048
#: Rows whose texts are taken out of Arrow at a time.
_ROWS = 256


def shingles(text: str | None, size: int) -> set[bytes]:
    """The ``size``-word shingles; a shorter text is one shingle, a blank one the empty shingle."""
    parts = (text or "").encode().lower().split()
    return {b" ".join(parts[k : k + size]) for k in range(max(1, len(parts) - size + 1))}


def sketch(text: str | None, size: int, seed: int) -> np.ndarray:
    """``BANDS`` signed longs; texts agree in one of them if ``ROWS`` least hashes of their shingles agree."""
    rng = np.random.default_rng(seed)
    factor = rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    mask = rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
    h = np.array([xxhash.xxh64_intdigest(s, seed) for s in shingles(text, size)], dtype="<u8")
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for k in range(0, len(h), 1 << 12):
        least = np.minimum(least, ((h[k : k + (1 << 12), None] ^ mask) * factor).min(axis=0))
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(least.reshape(BANDS, ROWS))], dtype="<u8").view(np.int64)


def _sketched(docs: DataFrame, *, id_col: str, text_col: str, size: int, seed: int) -> DataFrame:
    """Id, ``digest`` of the text, ``fingerprint`` and ``bands`` of every row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, _ROWS):
                part = b.slice(k, _ROWS)
                texts = part.column(2).to_pylist()
                fp = np.fromiter((fingerprint(t, size, seed) for t in texts), np.uint64, len(texts)).view(np.int64)
                bands = [sketch(t, size, seed) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fp), pa.array(bands, pa.list_(pa.int64()))], [id_col, "digest", "fingerprint", "bands"])

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col), _digest(text_col).alias("digest"), text_or_empty(text_col).alias("t"))
    return narrow.mapInArrow(of, f"`{id_col}` {kind}, digest binary, fingerprint long, bands array<long>")


def _digest(text_col: str):
    """SHA-256: what tells texts apart, as shorter hashes of different texts can be made equal."""
    return F.unhex(F.sha2(text_or_empty(text_col), 256))


def _texts(docs: DataFrame, names: DataFrame, need: DataFrame, scratch: Scratch, label: str, *, text_col: str) -> DataFrame:
    """``node`` and ``t`` of the needed nodes (one column); ``names``: ``digest`` and ``node`` of all."""
    need = scratch.written(names.join(need.toDF("needed"), F.col("node") == F.col("needed")).select("digest", "node"), f"needed-{label}")
    found = by_id(docs.select(_digest(text_col).alias("digest"), text_or_empty(text_col).alias("t")), need.select("digest"), "digest", "left_semi").dropDuplicates(["digest"])
    return scratch.written(found.join(need, "digest").select("node", "t"), f"texts-{label}")


def _verified(pairs: DataFrame, docs: DataFrame, names: DataFrame, scratch: Scratch, label: str, *, text_col: str, size: int, similarity: tuple[int, int]) -> DataFrame:
    """Those of the ``pairs`` (nodes a, b) whose texts' sets of shingles are similar, counted exactly."""
    need = pairs.select(F.col("a").alias("need")).unionByName(pairs.select(F.col("b").alias("need"))).distinct()
    texts = _texts(docs, names, need, scratch, label, text_col=text_col)
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("t").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("t").alias("tb")), "b")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = shingles(x.as_py(), size), shingles(y.as_py(), size)
                shared = len(x & y)
                near.append(similarity[1] * shared >= similarity[0] * (len(x) + len(y) - shared))
            yield b.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    out = scratch.written(both.select("a", "b", "ta", "tb").mapInArrow(of, "a long, b long"), f"verified-{label}")
    scratch.drop(f"texts-{label}")
    return out


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many hashes each of ``left`` (arrays without repeats) shares with each of ``right``."""
    parts = [*left, *right]
    owner = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
    _, column, n = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    some = n[column] > 1
    owner, column = owner[some], np.unique(column[some], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(left), len(right)), np.float32)
    edges = np.searchsorted(column, np.arange(0, column.max(initial=-1) + 1 + _COLUMNS, _COLUMNS))
    for k, (x, y) in enumerate(zip(edges, edges[1:], strict=False)):
        has = np.zeros((len(parts), _COLUMNS), np.float32)
        has[owner[x:y], column[x:y] - k * _COLUMNS] = 1
        total += has[: len(left)] @ has[len(left) :].T
    return total.astype(np.int64)


def _between(members: DataFrame, docs: DataFrame, names: DataFrame, scratch: Scratch, *, text_col: str, size: int, similarity: tuple[int, int]) -> DataFrame:
    """Links between ``members`` (band, root, node, n: members of the band) of one band and different roots.

    The members of a band are dealt into blocks, and every two blocks meet in one task, which
    compares them all and yields a spanning forest of the links: no pair is ever a row, and
    no group of any size lies in one task.
    """
    blocks = F.ceil(F.col("n") / BLOCK_ROWS)
    dealt = members.withColumn("own", F.pmod(F.xxhash64("node", "band"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    dealt = dealt.select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "root", "node")
    texts = _texts(docs, names, members.select("node").distinct(), scratch, "between", text_col=text_col)

    def meet(key: tuple, rows: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        own, root, node, text = (rows[c].to_numpy() if c != "t" else rows[c] for c in ("own", "root", "node", "t"))
        hashes = [np.unique(np.array([xxhash.xxh64_intdigest(x, 42) for x in shingles(t.as_py(), size)], np.uint64)) for t in text]
        a, b = np.flatnonzero(own == i), np.flatnonzero(own == j)
        sizes = np.array([len(h) for h in hashes])
        shared = _overlaps([hashes[k] for k in a], [hashes[k] for k in b]) if len(a) and len(b) else np.zeros((len(a), len(b)), np.int64)
        near = (similarity[1] * shared >= similarity[0] * (sizes[a][:, None] + sizes[b][None, :] - shared)) & (root[a][:, None] != root[b][None, :])
        group = {r: r for r in root.tolist()}

        def top(r: int) -> int:
            while group[r] != r:
                r = group[r]
            return r

        out = [[], []]
        for x, y in zip(*(k.tolist() for k in np.nonzero(near)), strict=True):
            x, y = int(a[x]), int(b[y])
            p, q = top(int(root[x])), top(int(root[y]))
            if p == q:
                continue
            one, two = shingles(text[x].as_py(), size), shingles(text[y].as_py(), size)
            if similarity[1] * len(one & two) >= similarity[0] * len(one | two):
                group[max(p, q)] = min(p, q)
                out[0].append(int(node[x]))
                out[1].append(int(node[y]))
        return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

    met = dealt.join(texts, "node").groupBy("band", "i", "j").applyInArrow(meet, "a long, b long").distinct()
    out = scratch.written(met, "linked-between")
    scratch.drop("texts-between")
    return out


def similar(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SIMILAR_WORDS, similarity: tuple[int, int] = SIMILAR, budget: int = BITS, seed: int = 42, scratch: Scratch | None = None) -> DataFrame:
    """Id and ``component_id`` of every row, as in ``near_duplicates``, linked by Jaccard similarity.

    Candidates are the links of the fingerprints' trie and the texts that share a MinHash
    band; each is checked exactly.  At similarity 0.8 fingerprints differ in about ten
    bits, where a trie prunes next to nothing, so the bands carry the recall.  Of a band's
    texts the first check is with one of them; then what is still in different components
    is compared block by block, and only links become rows.
    """
    scratch = scratch or Scratch(docs.sparkSession, "similar")

    def rooted_by(edges: DataFrame, label: str) -> DataFrame:
        own = Scratch(docs.sparkSession, "components")
        found = scratch.written(components(edges, own), label)
        own.drop()
        return found

    rows = scratch.written(_sketched(docs, id_col=id_col, text_col=text_col, size=size, seed=seed), "sketches")
    # texts are told apart by SHA-256 and go on under numbers in the order of their digests
    texts = rows.groupBy("digest").agg(F.first("fingerprint").alias("fingerprint"), F.first("bands").alias("bands"), F.count("*").alias("n"))
    nodes = scratch.written(ranked(texts, ["digest"], scratch, "ranked", "node"), "nodes")
    scratch.drop("ranked")
    names = nodes.select("digest", "node")
    banded = nodes.select("node", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    banded = scratch.written(banded.join(shared, "band"), "banded")
    exact = {"text_col": text_col, "size": size, "similarity": similarity}

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct()

    named = scratch.written(nodes.groupBy("fingerprint").agg(F.min("node").alias("named")), "named")
    trie = links(named.select("fingerprint"), budget=budget)
    trie = trie.join(named.toDF("a", "x"), "a").join(named.toDF("b", "y"), "b").select("x", "y")
    equal = nodes.select("node", "fingerprint").join(named, "fingerprint").select(F.col("node").alias("x"), F.col("named").alias("y"))
    # four orders of the nodes, so that a group is not hung on one text alone
    first = banded.groupBy("band").agg(F.min_by("node", F.xxhash64("node", F.col("band") % 4)).alias("y"))
    stars = banded.join(first, "band").select(F.col("node").alias("x"), "y")
    pairs = scratch.written(ordered(trie.unionByName(equal).unionByName(stars)), "pairs")
    edges = _verified(pairs, docs, names, scratch, "first", **exact)
    roots = rooted_by(edges, "roots")

    def rooted(df: DataFrame) -> DataFrame:
        return df.join(roots.withColumnRenamed("node", "at"), F.col("node") == F.col("at"), "left").withColumn("root", F.coalesce("root", "node")).drop("at")

    members = rooted(banded).select("band", "root", "node")
    several = members.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low < high").select("band", "n")
    members = scratch.written(members.join(several, "band"), "members")
    if not members.isEmpty():
        more = _between(members, docs, names, scratch, **exact)
        roots = rooted_by(edges.unionByName(more), "roots-of-all")
    named = skew_join(rows.select(id_col, "digest"), rooted(nodes.select("digest", "node")).select("digest", "root"), "digest", nodes.select("digest", "n"))
    found = scratch.written(named.select(id_col, "root"), "rooted")
    least = scratch.written(found.groupBy("root").agg(F.min(id_col).alias("component_id"), F.count("*").alias("n")), "least")
    return skew_join(found, least.drop("n"), "root", least).select(F.col(id_col), "component_id")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", of=near_duplicates, **params) -> DataFrame:
    """``docs`` with one row of each component: the least by id, then by the text's digest.

    ``of``: ``near_duplicates`` or ``similar``.  Rows are told apart by id and text, so rows
    that repeat only an id are decided one by one; of rows equal in both, one stays.  Rows
    with a null id cannot be named by a component and stay.
    """
    key = fresh_name(docs.columns, "row_key")
    own_key = F.when(F.col(id_col).isNotNull(), F.struct(F.col(id_col).alias("id"), F.coalesce(F.unhex(F.sha2(F.col(text_col).cast("string"), 256)), F.lit(b"")).alias("digest")))
    keyed = docs.withColumn(key, own_key)
    scratch = Scratch(docs.sparkSession, "keep-one")
    found = of(keyed, id_col=key, text_col=text_col, scratch=scratch, **params)
    own = F.coalesce(F.col(key) == F.col("component_id"), F.lit(False))
    ids = found.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(own).alias("kept"), F.count("*").alias("n")).where("not kept or n > 1")
    ids = written(ids, "dropped-or-repeated")
    scratch.drop()
    kept = by_id(keyed, ids.where("not kept").select(key), key, "left_anti")
    again = ids.where("kept").select(key)
    if again.isEmpty():
        return kept.drop(key)
    return by_id(kept, again, key, "left_anti").unionByName(by_id(kept, again, key, "left_semi").dropDuplicates([key])).drop(key)
