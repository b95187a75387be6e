"""Minimax contiguous partition of atomic groups into shards.

Groups (equal texts) are ordered by the digest of their text.  A binary search finds the
smallest capacity with which a greedy walk over the ordered sizes needs no more than the
given shards.  The walk sees blocks of consecutive groups instead of single groups: first
all groups by the leading digits of their digest, a fixed number of blocks, then finer
blocks wherever a cut may fall, until each such place is resolved to single groups.  So
the driver holds a bounded summary, whatever the number of groups, and the result is exact.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import text_or_empty, written
from .packing import numbered

SHARDS = 40
#: Hexadecimal digits of the first blocks: 16 to that power of them.
FIRST_DIGITS = 3
#: Places that still have no more groups than this are resolved to single groups at once.
AT_ONCE = 20_000


class Blocks:
    """Blocks of consecutive groups in digest order: (prefix, bytes, groups, largest group)."""

    def __init__(self, rows: list[tuple[str, int, int, int]], shards: int):
        self.rows = sorted(rows)
        self.sums = [0, *accumulate(r[1] for r in self.rows)]
        self.largest = max((r[3] for r in self.rows), default=0)
        self.total = self.sums[-1]
        #: Start of the block and size of its largest group where that is above an average shard's: no more than there are shards.
        self.large = [(s, r[3]) for s, r in zip(self.sums, self.rows, strict=False) if r[3] * shards > self.total]

    def single(self, k: int) -> bool:
        return self.rows[k][2] == 1

    def next_cut(self, at: float, capacity: int, fluid: bool) -> float:
        """End of the shard that starts at ``at`` and takes all it can: at a block's end, or, where ``fluid``, anywhere in a block of several groups."""
        most = at + capacity
        if most >= self.total:
            return self.total
        k = bisect_right(self.sums, most) - 1
        inside = self.sums[k]
        if fluid and not self.single(k) or inside <= at and not self.single(k):
            return most
        return inside

    def cuts(self, capacity: int, shards: int, fluid: bool) -> list[float]:
        out, at = [], 0
        for _ in range(shards):
            at = self.next_cut(at, capacity, fluid)
            out.append(at)
            if at >= self.total:
                break
        return out

    def fits(self, capacity: int, shards: int, fluid: bool) -> bool:
        if capacity < self.largest or not fluid and any(r[1] > capacity for r in self.rows):
            return False
        return self.cuts(capacity, shards, fluid)[-1] >= self.total

    def least_capacity(self, shards: int, fluid: bool) -> int:
        low, high = max(self.largest, -(-self.total // shards)), max(self.total, 1)
        while low < high:
            mid = (low + high) // 2
            if self.fits(mid, shards, fluid):
                high = mid
            else:
                low = mid + 1
        return low

    def unresolved(self, low: float, high: float) -> list[int]:
        """Blocks of several groups that meet [low, high]."""
        a = max(0, bisect_left(self.sums, low) - 1)
        return [k for k in range(a, min(len(self.rows), bisect_right(self.sums, high))) if not self.single(k)]

    def fair_share(self, at: int, left: int) -> float:
        """Share of each of ``left`` shards in what follows ``at``, groups above that share set apart."""
        rest, large = self.total - at, sorted((b for start, b in self.large if start >= at), reverse=True)
        for b in large:
            if left > 1 and b > rest / left:
                rest, left = rest - b, left - 1
        return rest / left

    def balanced(self, capacity: int, shards: int) -> tuple[list[int], set[int]]:
        """Ends of all shards, none above ``capacity`` and each near an equal share of what is left; blocks that hid a better cut."""
        touched: set[int] = set()
        latest = [self.total]  # latest[j]: the last j shards can start here at the earliest
        for _ in range(shards):
            least = latest[-1] - capacity
            k = bisect_left(self.sums, max(0, least))
            if k and self.sums[k] != least and not self.single(k - 1) and least > 0:
                touched.add(k - 1)
            latest.append(self.sums[k])
        ends, at = [], 0
        for s in range(shards):
            left = shards - s
            want = at + self.fair_share(at, left)
            low, high = max(at, latest[left - 1]), min(at + capacity, self.total)
            k = bisect_right(self.sums, want) - 1
            if k < len(self.rows) and self.sums[k] < want and not self.single(k):
                touched.add(k)
            j = bisect_right(self.sums, high) - 1
            if j < len(self.rows) and self.sums[j] < high and not self.single(j) and want >= high:
                touched.add(j)
            options = [x for x in (self.sums[k], self.sums[min(k + 1, len(self.rows))], self.sums[j], low) if low <= x <= high]
            filled = [x for x in options if x > at]  # no shard stays empty while groups are left
            at = min(filled or options, key=lambda x: (abs(x - want), x)) if options else low
            ends.append(at)
        ends[-1] = self.total
        return ends, touched


def _blocks(groups: DataFrame, digits: int, within: list[str] | None = None) -> list[tuple[str, int, int, int]]:
    """Blocks by the first ``digits`` of the digest, or of those ``within`` the given prefixes of one length."""
    if within:
        groups = groups.where(F.substring("digest", 1, len(within[0])).isin(within))
    got = groups.groupBy(F.substring("digest", 1, digits).alias("prefix")).agg(F.sum("bytes"), F.count("*"), F.max("bytes"))
    return [(r[0], r[1], r[2], r[3]) for r in got.collect()]


def _finer(groups: DataFrame, blocks: Blocks, which: set[int], shards: int) -> Blocks:
    """``blocks`` with those of index ``which`` replaced by finer ones."""
    rows = [r for k, r in enumerate(blocks.rows) if k not in which]
    by_size: dict[int, list[tuple[str, int, int, int]]] = {}
    for k in which:
        by_size.setdefault(len(blocks.rows[k][0]), []).append(blocks.rows[k])
    for size, old in by_size.items():
        digits = 64 if sum(r[2] for r in old) <= AT_ONCE else size + 1
        rows += _blocks(groups, digits, sorted(r[0] for r in old))
    return Blocks(rows, shards)


def boundaries(groups: DataFrame, shards: int = SHARDS) -> tuple[int, list[str]]:
    """The smallest feasible capacity in bytes, and the digest prefixes at which shards 1, 2 ... start.

    ``groups``: written table of ``digest`` (hexadecimal, distinct) and ``bytes``.
    """
    blocks = Blocks(_blocks(groups, FIRST_DIGITS), shards)
    if not blocks.rows:
        return 0, []
    while True:
        low, high = blocks.least_capacity(shards, True), blocks.least_capacity(shards, False)
        if low == high:
            break
        early, late = blocks.cuts(low, shards, False), blocks.cuts(high, shards, True)
        pairs = zip(early, [*late, *[blocks.total] * (len(early) - len(late))], strict=False)
        which = {k for a, b in pairs for k in blocks.unresolved(min(a, b), max(a, b))}
        which |= {k for at in blocks.cuts(low, shards, True) for k in blocks.unresolved(at, at)}
        which |= {k for k, r in enumerate(blocks.rows) if r[1] > low and r[2] > 1}
        if not which:
            break
        blocks = _finer(groups, blocks, which, shards)
    capacity = high
    while True:
        ends, touched = blocks.balanced(capacity, shards)
        if not touched:
            break
        blocks = _finer(groups, blocks, touched, shards)
    starts = [bisect_left(blocks.sums, e) for e in ends[:-1]]
    return capacity, [blocks.rows[k][0] if k < len(blocks.rows) else "g" for k in starts]


def sharded(docs: DataFrame, *, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``size`` (UTF-8 bytes plus 16), ``text_crc32``,
    ``digest`` (SHA-256 of the text, hexadecimal), ``shard`` and ``slot`` (gapless from 0).

    Equal texts share a shard, and shards are contiguous in digest order.  The largest shard
    is as small as that allows; within it the other cuts lie near equal shares.  Null text
    counts as empty and so goes with the empty texts.  Repeated rows each get a slot.  With
    fewer groups than shards, some shards are empty.  An empty table gives an empty result.
    Other columns are not read.  The shard of a text hangs on the texts alone; the slots in a
    shard follow the order in which the input was read.
    """
    t = text_or_empty(text_col)
    rows = docs.select(
        F.col(id_col), (F.octet_length(t) + 16).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"),
        F.sha2(t, 256).alias("digest"), F.monotonically_increasing_id().alias("row"),
    )
    rows = written(rows, "sizes")
    groups = written(rows.groupBy("digest").agg(F.sum("size").alias("bytes")), "groups")
    _, starts = boundaries(groups, shards)
    shard = F.size(F.filter(F.array(*map(F.lit, starts)) if starts else F.array().cast("array<string>"), lambda s: s <= F.col("digest")))
    placed = numbered(rows.withColumn("shard", shard), "shard")
    return placed.select(id_col, "size", "text_crc32", "digest", "shard", F.col("position").cast("long").alias("slot"))
