"""Best-fit packing of pieces into sequences by bin completion over the lengths' histogram.

Only lengths matter for a packing, and there are at most ``capacity`` different ones whatever the
number of pieces. So the histogram of lengths, one number per length, is packed into patterns with
multiplicities (`pack_lengths`), and Spark gives each piece its place: its rank among the pieces of its
length says which copy of which pattern it fills.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsflow.llm.store import written

#: Nodes of the search and fillings weighed per node; when the nodes are used up the best packing so far is taken.
NODES, FILLINGS = 6_000, 64

Pattern = tuple[tuple[tuple[int, int], ...], int]  # ((length, copies), ...), number of sequences


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs: the total's share, or pieces too long to share one."""
    lengths = np.arange(capacity + 1)
    total = int((counts * lengths).sum())
    best = -(-total // capacity)
    # For each k: longer than capacity - k stand alone; those above half don't share; what of the rest doesn't fit beside them needs room.
    for k in np.flatnonzero(counts[:capacity // 2 + 1]).tolist():
        alone = int(counts[capacity - k + 1:].sum()) if k else 0
        half = slice(capacity // 2 + 1, capacity - k + 1)
        room = int((counts[half] * (capacity - lengths[half])).sum())
        rest = int((counts[k:capacity // 2 + 1] * lengths[k:capacity // 2 + 1]).sum())
        best = max(best, alone + int(counts[half].sum()) + max(0, -(-(rest - room) // capacity)))
    return best


def best_fit(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Best-fit decreasing, for all pieces of a length at once: fullest sequences that have room first."""
    open_: dict[int, list[list]] = {}  # room left -> [contents, number of sequences]
    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        if not length:
            continue
        changed: list[tuple[int, list]] = []
        for room in sorted(r for r in open_ if r >= length):
            fit = room // length
            groups = open_[room]
            while groups and left:
                contents, number = groups.pop()
                full = min(number, left // fit)
                if full:
                    changed.append((room - fit * length, [contents + ((length, fit),), full]))
                    left -= full * fit
                    number -= full
                if number and left:  # fewer than fit are left
                    changed.append((room - left * length, [contents + ((length, left),), 1]))
                    left, number = 0, number - 1
                if number:
                    groups.append([contents, number])
            if not groups:
                del open_[room]
            if not left:
                break
        if left:
            fit = capacity // length
            if left // fit:
                changed.append((capacity - fit * length, [((length, fit),), left // fit]))
            if left % fit:
                changed.append((capacity - left % fit * length, [((length, left % fit),), 1]))
        for room, group in changed:
            open_.setdefault(room, []).append(group)
    return [(contents, number) for groups in open_.values() for contents, number in groups]


def _dominates(one: tuple[int, ...], two: tuple[int, ...]) -> bool:
    """Whether the items of ``two`` fit into the items of ``one``, seen as small sequences."""
    if not two:
        return True
    item, tried = two[0], set()
    for i, room in enumerate(one):
        if room >= item and room not in tried:
            tried.add(room)
            if _dominates(one[:i] + (room - item,) + one[i + 1:], two[1:]):
                return True
    return False


def fillings(lengths: list[int], counts: dict[int, int], room: int, most: int = FILLINGS) -> list[tuple[int, ...]]:
    """Undominated ways to fill ``room``, fullest first; only such that leave no room for a further item."""
    found: list[tuple[int, ...]] = []
    steps = 0

    def search(at: int, left: int, taken: tuple[int, ...], passed: int) -> None:
        nonlocal steps
        steps += 1
        if len(found) >= most or steps > 40 * most:
            return
        used = 0
        for i in range(at, len(lengths)):
            length = lengths[i]
            have = counts[length] - (taken.count(length) if used == 0 and taken and taken[-1] == length else 0)
            if length <= left and have > 0:
                used += 1
                search(i, left - length, taken + (length,), passed)
                # Leaving it out is complete only if it no longer fits in the end.
                passed = min(passed, length)
                if len(found) >= most:
                    return
        if left < passed and not any(x <= left and counts[x] > taken.count(x) for x in lengths[at:]):
            found.append(taken)

    search(0, room, (), room + 1)
    found.sort(key=lambda f: (-sum(f), len(f)))
    out: list[tuple[int, ...]] = []
    for f in found:
        if not any(len(f) <= 8 and _dominates(g, f) for g in out[:16]):
            out.append(f)
    return out


def pack_lengths(counts: np.ndarray, capacity: int, nodes: int = NODES) -> tuple[list[Pattern], bool]:
    """Patterns that hold all pieces in few sequences, and whether they are proven to be the fewest.

    ``counts[n]`` pieces have length n. The best-fit packing is the first incumbent. While the lower bound is not
    met, bin completion takes the longest piece left, tries the undominated fillings around it, as often at
    once as the pieces allow and then once, and gives up a branch whose waste exceeds what a better packing can waste.
    """
    incumbent = best_fit(counts, capacity)
    number = sum(n for _, n in incumbent)
    bound = lower_bound(counts, capacity)
    if number == bound:
        return incumbent, True
    total = int((counts * np.arange(capacity + 1)).sum())
    left = {int(i): int(counts[i]) for i in np.flatnonzero(counts) if i}
    chosen: list[Pattern] = []

    def options() -> Iterator[tuple[tuple[int, ...], int]]:
        lengths = sorted((x for x, n in left.items() if n), reverse=True)
        longest = lengths[0]
        left[longest] -= 1
        found = fillings([x for x in lengths if x <= capacity - longest and left[x]], left, capacity - longest)
        left[longest] += 1
        for f in found or [()]:
            items = (longest, *f)
            times = min(left[x] // items.count(x) for x in set(items))
            yield items, times
            if times > 1:
                yield items, 1

    stack = [(options(), None)]
    waste = used = 0
    complete = True
    while stack:
        nodes -= 1
        if nodes < 0:
            complete = False
            break
        step = next(stack[-1][0], None)
        if step is None:
            undo = stack.pop()[1]
            if undo:
                items, times = undo
                for x in items:
                    left[x] += times
                waste -= times * (capacity - sum(items))
                used -= times
                chosen.pop()
            continue
        items, times = step
        lost = waste + times * (capacity - sum(items))
        if lost > (number - 1) * capacity - total:
            continue
        for x in items:
            left[x] -= times
        waste, used = lost, used + times
        chosen.append((tuple((x, items.count(x)) for x in sorted(set(items), reverse=True)), times))
        if any(left.values()):
            stack.append((options(), (items, times)))
            continue
        incumbent, number = list(chosen), used
        for x in items:
            left[x] += times
        waste, used = waste - times * (capacity - sum(items)), used - times
        chosen.pop()
        if number == bound:
            return incumbent, True
    return incumbent, complete


@dataclass
class Places:
    """For each length, stretches of ranks and the copies of a pattern they fill."""

    key: np.ndarray  # length << 40 | first rank, ascending
    sequence: np.ndarray
    copies: np.ndarray
    offset: np.ndarray

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, (length << 40) | rank, "right") - 1
        within = rank - (self.key[at] & ((1 << 40) - 1))
        return self.sequence[at] + within // self.copies[at], self.offset[at] + within % self.copies[at] * length


def places(patterns: list[Pattern]) -> Places:
    rows, taken, sequence = [], {}, 0
    for contents, number in patterns:
        offset = 0
        for length, copies in contents:
            first = taken.get(length, 0)
            rows.append(((length << 40) | first, sequence, copies, offset))
            taken[length] = first + copies * number
            offset += copies * length
        sequence += number
    rows.sort()
    return Places(*(np.array(c, np.int64) for c in zip(*rows))) if rows else Places(*[np.zeros(0, np.int64)] * 4)


def pack(pieces: DataFrame, capacity: int, nodes: int = NODES) -> DataFrame:
    """``pieces`` with sequence_id and offset: where each piece of 1 to ``capacity`` (column length) goes.

    Sequences are gapless from offset 0 and hold at most ``capacity``. Other columns are kept (a column named like one of the
    new ones is replaced). An empty table stays empty; a null or impossible length raises. The histogram, at most ``capacity``
    rows, is all that the driver sees; a pattern holds at least one piece, and each step of the packing uses up a length or a
    group, so that the table of patterns that tasks get depends on ``capacity`` and not on the number of pieces.
    """
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            length = batch.column("length").to_numpy()
            if len(length) and (length.min() < 1 or length.max() > capacity):
                raise ValueError(f"a piece has a length outside 1 to {capacity}")
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            begin = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))[:len(ordered)]
            rank = np.empty(len(length), np.int64)
            rank[order] = np.arange(len(length)) - np.repeat(begin, np.diff(begin, append=len(length)))
            rank += seen[length]
            seen += np.bincount(length, minlength=capacity + 1)
            yield batch.append_column("rank_", pa.array(rank))

    base = pieces.select(*names, F.spark_partition_id().alias("part_"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
    numbered = written(base.mapInArrow(number, f"{schema}, rank_ long"), "pieces")
    found = numbered.groupBy("part_", "length").agg(F.count("*").alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for row in numbered.groupBy("length").agg(F.count("*").alias("n")).collect():
        counts[row["length"]] = row["n"]
    table = places(pack_lengths(counts, capacity, nodes)[0])
    before = Window.partitionBy("length").orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = found.select("part_", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before_"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy().astype(np.int64) for c in ("length", "rank_"))
            sequence, offset = table.of(length, rank)
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    ranked = numbered.join(offsets, ["part_", "length"]).withColumn("rank_", F.col("rank_") + F.col("before_")).select(*names, "rank_")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank_")
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")
