"""Exact removal of repeated byte strings: a difference-cover suffix sort cut to ``LENGTH`` bytes.

Suffixes are compared on ``LENGTH`` bytes only, so a sparse cover takes the place of residues
modulo 3: with ``COVER`` modulo ``PERIOD`` any two places are moved onto two sampled ones by a
common shift below ``PERIOD``.

1. The ``GRAM`` bytes at sampled places are sorted; equal ones share a name.  ``GRAM`` is what
   a window of ``LENGTH`` bytes still holds after the greatest shift, so equal windows hold a
   sampled place of the same name at the same distance from their starts.
2. Only names that two documents share go on; a name of one document decides all its windows.
   With whole suffixes such names would be named again from triples of names; here every
   window around a shared name holds only ``PERIOD - 1`` bytes more, so the next sort settles it.
3. The suffixes within reach of a shared name, sampled or not, are merged: sorted by their
   first ``LENGTH`` bytes and compared with their neighbours.

Texts are sorted by id and cut by bytes into blocks of ``BLOCK_BYTES``, any number of them.  A block
sends its distinct names, sorted and as differences, to the tasks that hold a range of names each,
and gets the shared ones back, of windows one bit each.  So a name that every text has is
sent once per block, and a block sends no more requests than it has names.  Ranges of names are sorted one after another (``ROUNDS``), and each is cleared away
before the next, so the disk holds a fraction of all suffixes at a time.  For windows a name
is 96 bits of hash and the bit says whether an earlier block has it; repeats inside a block
are found in the block.  Copies of whole texts are set apart first, by SHA-256.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import ByteHash, runs
from ._common import Scratch, release_shuffles, shuffle_partitions, small_enough, text_or_empty

LENGTH = 50
#: Every difference modulo the period is one of two residues of its cover (fixed values).
COVERS = {31: (0, 1, 3, 8, 12, 18), 21: (0, 1, 4, 14, 16), 13: (0, 1, 3, 9), 7: (0, 1, 3), 3: (0, 1)}
PERIOD = 31
BLOCK_BYTES = 8 << 20
#: What a row counts for beside its text, so that a block of empty texts ends too.
ROW_BYTES = 64
#: Blocks that one task of the sort by id cuts, on average.
TASK_BLOCKS = 16
#: Bits of a block's number that tell the blocks of one task apart.
_CUT_BITS = 24
#: Suffixes, on average, that one task of a sort gets at once.
SORT_ROWS = 2_000_000
#: Ranges of names that are sorted one after another.
NAME_ROUNDS, WINDOW_ROUNDS = 1, 2
#: Bits of a sampled name; a name shared by chance only adds work.
NAME_BITS = 40
#: Digests of repeated texts are broadcast up to this many (40 bytes each, and an id); beyond it the join shuffles.
BROADCAST_COPIES = 200_000

_REQUEST = "bucket int, block long, n int, names binary, more binary"
_REPLY = "kind int, block long, bucket int, answer binary"


def _packed(values: np.ndarray) -> bytes:
    """Ascending integers as differences, byte plane by byte plane, without planes of zeros."""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    wide = max(1, (int(steps.max()).bit_length() + 7) // 8)
    return bytes([wide]) + np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :wide].T).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, : data[0]] = planes.T
    return np.cumsum(steps.view("<u8").reshape(-1), dtype=np.uint64)


def _ascending(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and where each begins in the sorted values."""
    values = np.sort(values)
    begins = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return values[begins], begins


class Sort:
    """How the names of ``bits`` bits are cut into buckets and the buckets into rounds."""

    def __init__(self, kind: int, bits: int, rows: float, rounds: int):
        self.kind, self.rounds = kind, rounds
        self.log = max(rounds - 1, math.ceil(rows / SORT_ROWS)).bit_length()
        self.shift = np.uint64(bits - self.log)

    def spans(self, names: np.ndarray, buckets: np.ndarray) -> list[tuple[int, int]]:
        """Where each of the ``buckets`` begins and ends in ascending names."""
        own = names >> self.shift
        return list(zip(*(np.searchsorted(own, buckets.astype(np.uint64), side).tolist() for side in ("left", "right")), strict=True))

    def filled(self, names: np.ndarray, turn: int) -> np.ndarray:
        """Buckets of a round that some of the ascending names are in."""
        own, _ = _ascending(names >> self.shift)
        return own[(own >= np.uint64(self.buckets(turn).start)) & (own < np.uint64(self.buckets(turn).stop))]

    def buckets(self, turn: int) -> range:
        return range((turn << self.log) // self.rounds, (turn + 1 << self.log) // self.rounds)

    def span(self, turn: int) -> tuple[int, int]:
        """First and last name of a round."""
        own = self.buckets(turn)
        return own.start << int(self.shift), (own.stop << int(self.shift)) - 1


class Block:
    """The texts of a block in the order of their ids; rows of equal ids have equal ranks."""

    def __init__(self, rows: pa.Table, length: int, period: int):
        ids = rows["id"].combine_chunks()
        order = pc.sort_indices(ids, null_placement="at_end")
        self.rows = rows.take(order)
        self.rank = pc.rank(ids.take(order), null_placement="at_end", tiebreaker="dense").to_numpy().astype(np.int64) - 1
        self.length, self.period, self.gram = length, period, length - period + 1
        self.hasher = ByteHash(11)

    def texts(self):
        """Runs of texts: (first row, end row, bytes, offsets)."""
        return runs(self.rows["t"])

    def sampled(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sampled places that a whole gram follows in their text, and the text of each."""
        size = np.diff(off)
        room = np.maximum(size - self.gram + 1, 0)
        cover = np.zeros(self.period, bool)
        cover[list(COVERS[self.period])] = True
        chosen = np.flatnonzero(np.resize(cover, room.max(initial=0)))
        count = np.searchsorted(chosen, room)
        of = np.repeat(np.arange(len(size)), count)
        rank = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        return chosen[rank] + off[of], of

    def names(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct names, ascending, and whether texts of two ids or more have them."""
        keys = [np.zeros(0, np.uint64)]
        for i, _, data, off in self.texts():
            at, of = self.sampled(data, off)
            one, _ = self.hasher.at(data, at, self.gram)
            # a name and a rank side by side in one number: a block has at most BLOCK_BYTES / ROW_BYTES ids and one, below 2 ** 24
            keys.append((one >> np.uint64(64 - NAME_BITS)) << np.uint64(64 - NAME_BITS) | self.rank[i + of].astype(np.uint64))
        key, _ = _ascending(np.concatenate(keys))
        name, begins = _ascending(key >> np.uint64(64 - NAME_BITS))
        return name, np.diff(begins, append=len(key)) > 1

    def windows(self, shared: np.ndarray, low: int = 0, high: int = 2**64 - 1):
        """For each run (first row, offsets, window starts, two hashes, text of each window) within reach of a shared name.

        ``shared``: ascending names; only windows with a first hash from ``low`` to ``high``.
        """
        for i, _, data, off in self.texts():
            at, of = self.sampled(data, off)
            one, _ = self.hasher.at(data, at, self.gram)
            some = _among(one >> np.uint64(64 - NAME_BITS), shared)
            at, of = at[some], of[some]
            step = np.zeros(len(data) + 1, np.int32)
            np.add.at(step, np.maximum(at - self.period + 1, off[of]), 1)
            np.add.at(step, at + 1, -1)
            reach = np.cumsum(step[:-1]) > 0
            start = np.flatnonzero(reach)
            doc = np.searchsorted(off, start, side="right") - 1
            whole = start + self.length <= off[doc + 1]
            start, doc = start[whole], doc[whole]
            one, two = self.hasher.at(data, start, self.length)
            if low or high < 2**64 - 1:
                turn = (one >= np.uint64(low)) & (one <= np.uint64(high))
                start, doc, one, two = start[turn], doc[turn], one[turn], two[turn]
            yield i, off, start, one, two >> np.uint64(32), doc


def _among(values: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    if not len(ascending):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(ascending, values), len(ascending) - 1)
    return ascending[at] == values


def _replied(replies: pa.Table, sort: Sort, names: np.ndarray) -> np.ndarray:
    """The bits that came back for the ascending names of a block."""
    out = np.zeros(len(names), bool)
    mine = replies.filter(pc.equal(replies["kind"], sort.kind))
    for (a, b), bits in zip(sort.spans(names, mine["bucket"].to_numpy()), mine["answer"], strict=True):
        out[a:b] = np.unpackbits(np.frombuffer(bits.as_buffer(), np.uint8), count=b - a).astype(bool)
    return out


def _shared_by(replies: pa.Table) -> np.ndarray:
    """The shared names of a block, ascending."""
    mine = replies.filter(pc.equal(replies["kind"], 0)).sort_by("bucket")
    return np.concatenate([np.zeros(0, np.uint64), *(_unpacked(x.as_py()) for x in mine["answer"])])


def _table(schema: list[tuple[str, pa.DataType]], columns: list[list]) -> pa.Table:
    return pa.table({name: pa.array(c, kind) for (name, kind), c in zip(schema, columns, strict=True)})


_REQUEST_TYPES = [("bucket", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), ("names", pa.binary()), ("more", pa.binary())]
_REPLY_TYPES = [("kind", pa.int32()), ("block", pa.int64()), ("bucket", pa.int32()), ("answer", pa.binary())]


def _requests(block: int, names: np.ndarray, more: np.ndarray | None, flags: np.ndarray | None, sort: Sort, turn: int) -> pa.Table:
    out: list[list] = [[], [], [], [], []]
    buckets = sort.filled(names, turn)
    for k, (a, b) in zip(buckets.tolist(), sort.spans(names, buckets), strict=True):
        extra = np.packbits(flags[a:b]).tobytes() if more is None else more[a:b].astype("<u4").tobytes()
        for column, value in zip(out, (k, block, b - a, _packed(names[a:b]), extra), strict=True):
            column.append(value)
    return _table(_REQUEST_TYPES, out)


def _distinct(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs in ascending order without repeats, the order of the input, and which of it begin a pair."""
    order = np.argsort(one, kind="stable")
    a, b = one[order], two[order]
    if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():
        order = np.lexsort((two, one))
        a, b = one[order], two[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new], order, new


def _shared_names(group: pa.Table) -> pa.Table:
    """Of each block's names those that texts of two ids have."""
    parts = [_unpacked(x.as_py()) for x in group["names"]]
    several = [p[np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=len(p)).astype(bool)] for p, x in zip(parts, group["more"], strict=True)]
    every = np.concatenate(parts)
    names, begins = _ascending(every)
    shared, _ = _ascending(np.concatenate([names[np.diff(begins, append=len(every)) > 1], *several]))
    found = [p[_among(p, shared)] for p in parts]
    some = [k for k, p in enumerate(found) if len(p)]
    columns = [[group[c][k].as_py() for k in some] for c in ("block", "bucket")]
    return _table(_REPLY_TYPES, [[0] * len(some), *columns, [_packed(found[k]) for k in some]])


def _earlier_windows(group: pa.Table) -> pa.Table:
    """One bit per requested window: whether a block before has it.  Neighbours in sorted order are compared."""
    group = group.sort_by("block")  # blocks are in the order of ids, and the sort below is stable
    parts = [_unpacked(x.as_py()) for x in group["names"]]
    one, two = np.concatenate(parts), np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in group["more"]])
    _, _, order, new = _distinct(one, two.astype(np.uint64))
    hit = np.empty(len(one), bool)
    hit[order] = ~new
    ends = np.cumsum([len(p) for p in parts])
    bits = [np.packbits(x).tobytes() for x in np.split(hit, ends[:-1])]
    return _table(_REPLY_TYPES, [[1] * len(bits), group["block"].to_pylist(), group["bucket"].to_pylist(), bits])


def _runs_of(gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _blocks(rows: DataFrame, limit: int) -> DataFrame:
    """``block``, ``id``, ``t`` of ``rows`` (id, t), whose partitions are in the order of ids and sorted by id.

    A block ends where ``limit`` bytes are full and the id changes, so rows of one id share a block.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << _CUT_BITS
        before, begun, last = 0, 0, None  # bytes so far, bytes before the id at hand, and that id's hash
        for b in batches:
            if not b.num_rows:
                continue
            size, key = b.column(2).to_numpy(), b.column(3).to_numpy()
            ends = before + np.cumsum(size)
            new = np.concatenate([[key[0] != last], key[1:] != key[:-1]])
            begins = np.where(new, ends - size, 0)
            if not new[0]:
                begins[0] = begun
            begins = np.maximum.accumulate(begins)
            before, begun, last = int(ends[-1]), int(begins[-1]), key[-1]
            yield pa.RecordBatch.from_arrays([pa.array(first + begins // limit, pa.int64()), b.column(0), b.column(1)], ["block", "id", "t"])

    sized = rows.select("id", "t", (F.octet_length("t").cast("long") + ROW_BYTES).alias("size"), F.xxhash64("id").alias("key"))
    return sized.mapInArrow(cut, f"block long, id {rows.schema['id'].dataType.simpleString()}, t string")


def repeated(texts: DataFrame, n_bytes: int, scratch: Scratch, *, length: int, period: int) -> DataFrame:
    """``id``, ``n_bytes``, ``spans`` and ``kept`` of every row of ``texts`` (block, id, t): a table bucketed by block, blocks in the order of ids."""
    spark = texts.sparkSession
    density = len(COVERS[period]) / period
    by_name, by_window = Sort(0, NAME_BITS, n_bytes * density, NAME_ROUNDS), Sort(1, 64, n_bytes, WINDOW_ROUNDS)
    blocks = texts.groupBy("block")
    replies = spark.createDataFrame([], _REPLY)  # names, then windows

    def asking_names(turn: int):
        def ask(key: tuple, rows: pa.Table) -> pa.Table:
            names, several = Block(rows, length, period).names()
            return _requests(key[0].as_py(), names, None, several, by_name, turn)

        return ask

    def asking_windows(turn: int):
        def ask(key: tuple, rows: pa.Table, answered: pa.Table) -> pa.Table:
            block = Block(rows, length, period)
            found = [(one, two) for _, _, _, one, two, _ in block.windows(_shared_by(answered), *by_window.span(turn))]
            none = np.zeros(0, np.uint64)
            one, two, _, _ = _distinct(np.concatenate([none, *(x[0] for x in found)]), np.concatenate([none, *(x[1] for x in found)]))
            return _requests(key[0].as_py(), one, two, None, by_window, turn)

        return ask

    def names_of(turn: int) -> DataFrame:
        asked = blocks.applyInArrow(asking_names(turn), _REQUEST)
        return scratch.written(asked.groupBy("bucket").applyInArrow(_shared_names, _REPLY), f"names-{turn}")

    def windows_of(turn: int, named: DataFrame) -> DataFrame:
        asked = blocks.cogroup(named.groupBy("block")).applyInArrow(asking_windows(turn), _REQUEST)
        return scratch.written(asked.groupBy("bucket").applyInArrow(_earlier_windows, _REPLY), f"windows-{turn}")

    for turn in range(NAME_ROUNDS):
        replies = replies.unionByName(names_of(turn))
        release_shuffles(spark)
    named = replies
    for turn in range(WINDOW_ROUNDS):
        replies = replies.unionByName(windows_of(turn, named))
        release_shuffles(spark)

    def decide(key: tuple, rows: pa.Table, answered: pa.Table) -> pa.Table:
        block = Block(rows, length, period)
        none = [np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        found = [none]
        for i, off, start, one, two, doc in block.windows(_shared_by(answered)):
            found.append([one, two, i + doc, start - off[doc]])
        one, two, doc, start = (np.concatenate([x[k] for x in found]) for k in range(4))
        names, _, order, new = _distinct(one, two)
        hit = _replied(answered, by_window, names)
        # neighbours of equal names: the texts after the first id are repeats even where no earlier block has the window
        group = np.cumsum(new) - 1
        rank = block.rank[doc[order]]
        first = np.minimum.reduceat(rank, np.flatnonzero(new)) if len(names) else rank
        again = np.zeros(len(one), bool)
        again[order] = (hit[group] | (rank > first[group])) if len(names) else False
        doc, start = doc[again], start[again]
        by_doc = np.argsort(doc, kind="stable")
        doc, start = doc[by_doc], start[by_doc]
        edges = np.searchsorted(doc, np.arange(len(block.rows) + 1))
        sizes, spans, kept = [], [], []
        for k, text in enumerate(block.rows["t"]):
            data = np.frombuffer(text.as_buffer(), np.uint8)
            sizes.append(len(data))
            at = start[edges[k] : edges[k + 1]]
            if not len(at):
                spans.append([])
                kept.append(data.tobytes())
                continue
            step = np.zeros(len(data) + 1, np.int32)
            np.add.at(step, at, 1)
            np.add.at(step, at + length, -1)
            gone = np.cumsum(step[:-1]) > 0
            spans.append([{"start": a, "end": b} for a, b in zip(*(x.tolist() for x in _runs_of(gone)), strict=True)])
            kept.append(data[~gone].tobytes())
        pairs = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.table({"id": block.rows["id"], "n_bytes": pa.array(sizes, pa.int64()), "spans": pa.array(spans, pairs), "kept": pa.array(kept, pa.binary())})

    kind = texts.schema["id"].dataType.simpleString()
    return blocks.cogroup(replies.groupBy("block")).applyInArrow(decide, f"id {kind}, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, period: int = PERIOD) -> DataFrame:
    """One row per row of ``docs``: id, ``n_bytes``, ``n_removed``, ``spans`` (array of start and
    end bytes, end exclusive, of the maximal removed ranges) and ``kept`` (the bytes left).

    A byte goes when a ``length``-byte string over it also starts in a document with a
    smaller id; strings are judged on the input and never cross documents.  Null text counts
    as empty.  Ids are of any type that Spark can sort; a null id is above all others, and rows
    that share an id, repeated rows among them, never remove each other's bytes.  Texts
    shorter than ``length`` stay whole.  An empty table gives an empty result.  Other columns
    are not read.  ``period``: one of ``COVERS``; ``length`` is ``period + 7`` at least.

    The result reads the blocks and replies in the shared folder, so these stay there.
    """
    if period not in COVERS or length < period + 7:
        raise ValueError(f"no cover of period {period} for strings of {length} bytes")
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix-dedup")
    t = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("id"), t.alias("t"), F.unhex(F.sha2(t, 256)).alias("digest"))
    sizes = rows.select("id", "digest", F.octet_length("t").cast("long").alias("size"))
    digests = sizes.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n"), F.count("id").alias("named"), F.max("size").alias("size"))
    digests = scratch.written(digests, "digests")
    copied = digests.where("first < last or (named > 0 and named < n)").select(F.col("digest").alias("copied"), "first")
    marked = rows.join(F.broadcast(copied) if small_enough(copied, BROADCAST_COPIES) else copied, F.col("digest") == F.col("copied"), "left")
    copy = F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("first")))
    total = digests.agg(F.sum((F.col("size") + ROW_BYTES) * F.col("n"))).first()[0] or 0

    n_blocks, order = -(-total // BLOCK_BYTES), F.col("id").asc_nulls_last()
    ordered = marked.where(~copy).select("id", "t").repartitionByRange(max(shuffle_partitions(spark), -(-n_blocks // TASK_BLOCKS)), order).sortWithinPartitions(order)
    # files of a table are cut by a hash of the block; where Spark allows fewer than there are blocks, one holds several
    n_files = min(max(shuffle_partitions(spark), n_blocks), int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    texts = scratch.bucketed(_blocks(ordered, BLOCK_BYTES), "texts", "block", n_files)
    release_shuffles(spark)

    found = repeated(texts, total, scratch, length=length, period=period)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]))
    found = found.select("id", "n_bytes", removed.alias("n_removed"), "spans", "kept")
    n = F.octet_length("t")
    long = n >= length
    whole = F.when(long, F.array(F.struct(F.lit(0).alias("start"), n.alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
    copies = marked.where(copy).select("id", n.cast("long").alias("n_bytes"), F.when(long, n).otherwise(0).cast("long").alias("n_removed"), whole.alias("spans"), F.when(long, F.lit(b"")).otherwise(F.col("t").cast("binary")).alias("kept"))
    return found.unionByName(copies).withColumnRenamed("id", id_col)


DEDUP_SQL = """
with b as (select doc_id, hex(encode(coalesce(text, ''))) as h, strlen(coalesce(text, '')) as n from documents),
places as (select doc_id, h, unnest(range(0, n - 49)) as i from b where n >= 50),
strings as (select doc_id, i, substr(h, 2 * i + 1, 100) as s from places),
first as (select s, min(doc_id) as first from strings group by s),
again as (select doc_id, i from strings join first using (s) where doc_id > first),
gone as (select distinct doc_id, p from (select doc_id, unnest(range(i, i + 50)) as p from again)),
counts as (select doc_id, count(*) as n_removed, count(*) filter (before is null or before < p - 1) as n_spans
  from (select doc_id, p, lag(p) over (partition by doc_id order by p) as before from gone) group by doc_id),
bytes as (select doc_id, h, unnest(range(0, n)) as p from b where doc_id in (select doc_id from counts)),
kept as (select doc_id, string_agg(substr(h, 2 * p + 1, 2), '' order by p) as k from bytes anti join gone using (doc_id, p) group by doc_id)
select doc_id, n as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
  sha256(unhex(case when n_removed is null then h else coalesce(k, '') end)) as kept_sha256
from b left join counts using (doc_id) left join kept using (doc_id)
"""
