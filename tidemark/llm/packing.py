"""Packing token pieces into sequences by linear grouping, on length counts alone.

How many pieces there are of each length is a table of ``capacity`` rows whatever the corpus size, and pieces of
equal length are interchangeable.  The driver plans on those counts: large lengths are rounded up within groups of
equal cardinality, a linear program over the few group sizes gives configurations and how often to use each, actual
lengths take the places of the rounded ones, and the small ones go by best fit into what is left.  The plan is a list
of runs (length, first rank, count, first sequence, offset); each piece finds its place by its rank among the pieces of
its length, which is counted in two steps without gathering a length in one task.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import slices, stored, work_dir
from tidemark.llm.tokens import crc_of, encoder, vocabulary_path

CAPACITY = 1024
GROUPS = 64
SMALL = 1 / 5


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of ``n`` ids: all full but the first, which takes the remainder."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def _pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int) -> DataFrame:
    """A row a piece; ``part`` and ``local`` number the pieces of each length inside the task that cut them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, part = encoder(vocabulary), TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for batch in batches:
            for small in slices(batch):
                rows = []
                for key, x in zip(small["doc_id"].to_pylist(), e.encode(small["text"].to_pylist()), strict=True):
                    ids = np.append(np.frombuffer(x, e.kind).astype("<u4"), np.uint32(end_id))
                    for i, (start, n) in enumerate(pieces_of(len(ids), capacity)):
                        rows.append((key, i, start, n, crc_of(ids[start : start + n]), part, seen[n]))
                        seen[n] += 1
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.record_batch(cols, ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def groups_of(counts: np.ndarray, sizes: list[int], k: int) -> list[tuple[int, int, int]]:
    """Linear grouping of the lengths ``sizes`` (descending): (rounded length, least length, pieces) of up to ``k`` groups."""
    total = int(counts[sizes].sum())
    out, held, top = [], 0, None
    for i, s in enumerate(sizes):
        top = top or s
        held += int(counts[s])
        if held * k >= total or i == len(sizes) - 1:
            out.append((top, s, held))
            held, top = 0, None
    return out


def configurations(sizes: list[int], need: list[int], capacity: int, most_steps: int = 4000) -> list[tuple[tuple[int, ...], float]]:
    """Fractional optimum of the configuration program: [(copies of each size, times)].

    Revised simplex with columns made on demand: a knapsack over the dual prices gives the next configuration.
    """
    k = len(sizes)
    basis = [tuple(capacity // s if i == j else 0 for j in range(k)) for i, s in enumerate(sizes)]
    inverse = np.diag([1.0 / (capacity // s) for s in sizes])
    x = inverse @ np.array(need, float)
    for _ in range(most_steps):
        price = inverse.sum(0)
        best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        usable = [j for j in range(k) if price[j] > 1e-9]
        for room in range(1, capacity + 1):
            top, arg = best[room - 1], -1
            for j in usable if len(usable) < 8 else ():
                if sizes[j] <= room and best[room - sizes[j]] + price[j] > top + 1e-12:
                    top, arg = best[room - sizes[j]] + price[j], j
            if len(usable) >= 8:
                s = _usable_sizes(sizes, usable)
                fit = s <= room
                if fit.any():
                    v = best[room - s[fit]] + price[usable][fit]
                    m = int(v.argmax())
                    if v[m] > top + 1e-12:
                        top, arg = v[m], int(np.flatnonzero(fit)[m])
                        arg = usable[arg]
            best[room], pick[room] = top, arg
        if best[capacity] <= 1 + 1e-6:
            break
        column, room = [0] * k, capacity
        while room > 0:
            if pick[room] < 0:
                room -= 1
            else:
                column[pick[room]] += 1
                room -= sizes[pick[room]]
        d = inverse @ np.array(column, float)
        ratio = np.where(d > 1e-9, x / np.maximum(d, 1e-9), np.inf)
        r = int(ratio.argmin())
        if not np.isfinite(ratio[r]):
            break
        inverse[r] /= d[r]
        step = ratio[r]
        x = x - step * d
        x[r] = step
        rest = np.arange(k) != r
        inverse[rest] -= np.outer(d[rest], inverse[r])
        basis[r] = tuple(column)
    return [(c, float(t)) for c, t in zip(basis, x, strict=True) if t > 1e-9]


def _usable_sizes(sizes: list[int], usable: list[int]) -> np.ndarray:
    return np.array([sizes[j] for j in usable])


class Plan:
    """Sequences as runs: ``count`` sequences alike, each a tuple of lengths.  ``left`` is what is not placed yet."""

    def __init__(self, counts: np.ndarray, capacity: int):
        self.left, self.capacity = counts.astype(np.int64).copy(), capacity
        self.by_room: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)

    def put(self, count: int, lengths: tuple[int, ...]) -> None:
        self.by_room[self.capacity - sum(lengths)].append((count, lengths))

    def largest(self, most: int, least: int = 1) -> int:
        """The largest length in [least, most] of which pieces are left, or 0."""
        found = np.flatnonzero(self.left[least : most + 1]) if most >= least else ()
        return least + int(found[-1]) if len(found) else 0

    def fill(self, count: int, slots: list[tuple[int, int]]) -> None:
        """``count`` sequences of one configuration; slots are (rounded, least) lengths, descending.

        Each place takes the largest piece of its group; the last one the largest piece of any length that fits.
        """
        runs: list[tuple[int, tuple[int, ...], int]] = [(count, (), self.capacity)]
        for i, (top, least) in enumerate(slots):
            last, after = i == len(slots) - 1, []
            while runs:
                n, lengths, room = runs.pop()
                s = self.largest(room if last and i else min(top, room), 1 if last and i else least)
                if not s:
                    if lengths:
                        after.append((n, lengths, room))
                    continue
                m = min(n, int(self.left[s]))
                self.left[s] -= m
                after.append((m, (*lengths, s), room - s))
                if n > m:
                    runs.append((n - m, lengths, room))
            runs = after
        for n, lengths, _ in runs:
            self.put(n, lengths)

    def best_fit(self, sizes: list[int]) -> None:
        """Pieces left of each of ``sizes`` (descending): into the tightest open sequences, else new ones."""
        for s in sizes:
            while self.left[s]:
                room = next((r for r in range(s, self.capacity) if self.by_room.get(r)), None)
                if room is None:
                    each = self.capacity // s
                    full, rest = divmod(int(self.left[s]), each)
                    for n, m in ((full, each), (1, rest)):
                        if n and m:
                            self.put(n, (s,) * m)
                    self.left[s] = 0
                    continue
                n, lengths = self.by_room[room].pop()
                m = min(n, int(self.left[s]))
                self.left[s] -= m
                self.put(m, (*lengths, s))
                if n > m:
                    self.by_room[room].append((n - m, lengths))

    def runs(self) -> np.ndarray:
        """Rows (length, first rank, count, first sequence, offset), ranks of a length ascending."""
        out, rank, sequence = [], defaultdict(int), 0
        for room in sorted(self.by_room):
            for n, lengths in self.by_room[room]:
                at = 0
                for s in lengths:
                    out.append((s, rank[s], n, sequence, at))
                    rank[s] += n
                    at += s
                sequence += n
        return np.array(out, np.int64).reshape(-1, 5)


def plan(counts: np.ndarray, capacity: int = CAPACITY, k: int = GROUPS, small: float = SMALL) -> Plan:
    """A plan for ``counts[length]`` pieces of each length up to ``capacity``."""
    p = Plan(counts, capacity)
    if p.left[capacity]:
        p.put(int(p.left[capacity]), (capacity,))
        p.left[capacity] = 0
    present = [int(s) for s in np.flatnonzero(p.left)[::-1]]
    large = [s for s in present if s > small * capacity]
    if large:
        groups = groups_of(p.left, large, k)
        found = configurations([g[0] for g in groups], [g[2] for g in groups], capacity)
        for column, times in sorted(found, reverse=True):
            slots = [(g[0], g[1]) for g, n in zip(groups, column, strict=True) for _ in range(n)]
            if int(times):
                p.fill(int(times), slots)
    p.best_fit([s for s in present if p.left[s]])  # the small ones, and what rounding the times down left over
    return p


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = 2) -> DataFrame:
    """Pieces of every text of ``docs`` (doc_id, text) with their sequence and offset in it.

    A null text counts as empty and gives one piece of the end id.  Repeated rows are packed each; a null doc_id is
    carried.  An empty table gives no rows.  Other columns are not read.
    """
    path = work_dir(docs.sparkSession)
    pieces = stored(_pieces(docs, vocabulary or vocabulary_path(), end_id, capacity), f"{path}/pieces")
    per = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        counts[r["length"]] = r["n"]
    runs = plan(counts, capacity).runs()
    by_length = {int(s): runs[runs[:, 0] == s][:, 1:] for s in np.unique(runs[:, 0])} if len(runs) else {}
    before = per.select(
        "part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for s in np.unique(length):
                here, mine = by_length[int(s)], length == s
                at = np.searchsorted(here[:, 0], rank[mine], "right") - 1
                sequence[mine] = here[at, 2] + rank[mine] - here[at, 0]
                offset[mine] = here[at, 3]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.record_batch([*(batch[c] for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    ranked = pieces.join(before, ["part", "length"]).withColumn("rank", F.col("before") + F.col("local"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, schema)
