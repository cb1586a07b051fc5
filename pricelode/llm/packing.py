"""Packing documents into sequences: best fit, then a local search by moves and swaps until none is left."""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelode.llm.bpe import encoder
from pricelode.llm.corpus import texts
from pricelode.llm.steps import written

#: Pieces packed together in one task, at any size of the corpus.
LOT = 40_000
#: Sequences with more free room than this share go on to be packed with those of other lots.
LOOSE = 0.02
_ITEM = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, row long"
_PLACED = _ITEM + ", sequence_id long, offset long, free long"


def pieces(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, row)``: every document's ids and ``end_id``, cut where they exceed a sequence.

    ``task`` and ``row`` number the pieces, so that rows without an id or with the same id are told apart as well.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, row, task = encoder(path), 0, TaskContext.get().partitionId()
        for batch in batches:
            out: list[tuple] = []
            slices = own.streams(batch.column(1).to_pylist())
            ahead = next(slices, None)
            for place, doc in enumerate(batch.column(0).to_pylist()):
                number, start, held = 0, 0, array("I")

                def full(ids: array, doc=doc) -> None:
                    nonlocal number, start, row
                    out.append((doc, number, start, len(ids), zlib.crc32(ids.tobytes()), task, row))
                    number, start, row = number + 1, start + len(ids), row + 1

                while ahead is not None and ahead[0] == place:
                    held += ahead[1]
                    while len(held) >= capacity:
                        full(held[:capacity])
                        held = held[capacity:]
                    ahead = next(slices, None)
                held.append(end_id)
                full(held)
            columns = zip(*out, strict=True) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int32(), *[pa.int64()] * 5], strict=True)],
                [f.split()[0] for f in _ITEM.split(", ")])

    return docs.mapInArrow(cut, _ITEM)


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each piece: longest first, each into the fullest bin that has room for it."""
    out = np.zeros(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, count = 0, 0  # bit r of rooms: some bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fits = rooms >> need
        if fits:
            room = need + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, count
            count += 1
        out[i] = b
        if left := room - need:
            by_room[left].append(b)
            rooms |= 1 << left
    return out


class _Bins:
    """Lengths held by bins, and for every length the roomiest bin that holds it; length 0 stands for no piece.

    Rooms are looked up in heaps, one for each length, whose outdated entries go when they come to the top.
    """

    def __init__(self, held: dict[int, Counter], room: dict[int, int], capacity: int):
        self.held, self.room, self.capacity = held, room, capacity
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
        self.best = np.zeros(capacity + 1, np.int64)
        self.open: dict[int, int] = {}  # bins that can take something, and the room they are listed with
        self.at = np.arange(capacity + 1)

    def _refresh(self, length: int) -> None:
        heap = self.heaps[length]
        while heap and not (self.open.get(heap[0][1]) == -heap[0][0] and (not length or self.held[heap[0][1]][length])):
            heappop(heap)
        self.best[length] = -heap[0][0] if heap else 0

    def add(self, b: int) -> None:
        if room := self.room[b]:
            self.open[b] = room
            for length in (0, *self.held[b]):
                heappush(self.heaps[length], (-room, b))
                self.best[length] = max(self.best[length], room)

    def remove(self, b: int) -> None:
        if room := self.open.pop(b, 0):
            for length in (0, *self.held[b]):
                if self.best[length] == room:
                    self._refresh(length)

    def step(self, source: int) -> int | None:
        """Gives one or two pieces of the source for a smaller one, or none, of an open bin; the target, or None if there is none.

        Of all such steps it takes one that moves most tokens."""
        held = self.held[source]
        own = np.fromiter(held, np.int64, len(held))
        pairs = np.add.outer(own, own)
        if single := [i for i, length in enumerate(own.tolist()) if held[length] == 1]:
            pairs[single, single] = 0
        given = np.concatenate([own, pairs.ravel()])
        # A piece of length l in a bin of room r can be had for more than l and at most l + r.
        reach = np.maximum.accumulate(np.where(self.best > 0, self.at + self.best, 0))
        back = np.searchsorted(reach, given)
        tokens = given - back
        k = int(np.argmax(tokens))
        if tokens[k] <= 0:
            return None
        out = [int(own[k])] if k < len(own) else [int(own[x]) for x in divmod(k - len(own), len(own))]
        taken = int(back[k])
        target = self.heaps[taken][0][1]
        self.remove(target)
        for length in out:
            _put(held, length, -1)
            _put(self.held[target], length, 1)
        if taken:
            _put(self.held[target], taken, -1)
            _put(held, taken, 1)
        self.room[source] += int(tokens[k])
        self.room[target] -= int(tokens[k])
        self.add(target)
        return target


def _put(held: Counter, length: int, n: int) -> None:
    held[length] += n
    if not held[length]:
        del held[length]


def local_search(lengths: np.ndarray, bins: np.ndarray, capacity: int) -> np.ndarray:
    """Empties underfull bins: moves one or two pieces out, or swaps them for a smaller one elsewhere.

    Every step moves tokens from a bin to one that is as full or fuller, so the sum of squared fills grows. Bins give in
    order of their room, the emptiest first, each until it has no step left; it ends when none of them has a step to any
    other, or when no fewer bins can hold the total.
    """
    bins = bins.copy()
    size = lengths.tolist()
    held: dict[int, Counter] = {}
    for length, b in zip(size, bins.tolist(), strict=True):
        held.setdefault(b, Counter())[length] += 1
    room = {b: capacity - sum(length * n for length, n in own.items()) for b, own in held.items()}
    least = -(-sum(size) // capacity)
    moved = True
    while moved and len(held) > least:
        moved = False
        state = _Bins(held, room, capacity)
        by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        for b in sorted(held):
            state.add(b)
            by_room[room[b]].append(b)
        for free in range(capacity, 0, -1):
            waiting, spent = by_room[free], []
            while waiting and len(held) > least:
                source = waiting.pop()
                if room.get(source) != free:
                    continue
                state.remove(source)
                while held[source] and (target := state.step(source)) is not None:
                    moved = True
                    by_room[room[target]].append(target)
                if not held[source]:
                    del held[source], room[source]
                elif room[source] == free:  # as full as the next ones, which may give to it
                    state.add(source)
                    spent.append(source)
            for b in spent:
                if room.get(b) == free:
                    state.remove(b)
    places: dict[int, list[int]] = {}
    for b in sorted(held):
        for length, n in held[b].items():
            places.setdefault(length, []).extend([b] * n)
    for i in range(len(size) - 1, -1, -1):
        bins[i] = places[size[i]].pop()
    return bins


def _packer(round_number: int, capacity: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "task", "row"], ascending=[False, True, True], ignore_index=True)
        lengths = pdf["length"].to_numpy(np.int64)
        bins = local_search(lengths, best_fit(lengths, capacity), capacity)
        pdf["sequence_id"] = (round_number << 56) + pdf["lot"].to_numpy(np.int64) * (1 << 28) + bins
        pdf["offset"] = pdf.groupby("sequence_id")["length"].cumsum() - pdf["length"]
        pdf["free"] = capacity - pdf.groupby("sequence_id")["length"].transform("sum")
        return pdf.drop(columns="lot")

    return pack


def packed(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096,
           end_id: int = 1, lot: int = LOT) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``: a place in a sequence for every piece.

    Lots of bounded size, dealt by a hash, are packed side by side. Sequences that stay loose are taken apart and packed
    again with those of other lots, until one lot holds all that is left, or a round neither saves a sequence nor halves the
    loose pieces; a last round that saves none is not used. A null or empty text is its end mark alone. Every row gives its pieces, also without an id
    or repeated. An empty table gives no rows; other columns are ignored. Steps are written when this is called.
    """
    items = written(pieces(texts(docs, id_col, text_col), path, capacity, end_id))
    whole = -(F.shiftleft("task", 36) + F.col("row")) - 1  # negative: apart from those of the lots
    zero = F.lit(0).cast("long")
    done = items.where(F.col("length") == capacity).select(
        "*", whole.alias("sequence_id"), zero.alias("offset"), zero.alias("free"))
    left = items.where(F.col("length") < capacity)
    loose = F.col("free") > LOOSE * capacity
    earlier, sequences = None, 0  # the loose sequences as last placed, and their number
    number = left.count()
    round_number = 0
    while number:
        lots = -(-number // lot)

        dealt = left.withColumn("lot", F.pmod(F.xxhash64("task", "row", F.lit(round_number)), F.lit(lots)))
        placed = written(dealt.groupBy("lot").applyInPandas(_packer(round_number, capacity), _PLACED))
        again = placed.where(loose)
        now, now_loose, left_over = placed.select(
            F.count_if(F.col("offset") == 0), F.count_if((F.col("offset") == 0) & loose), F.count_if(loose)).first()
        saved = earlier is None or now < sequences
        if lots == 1 or not (saved or 2 * left_over <= number):  # one lot has all that is left, or lots gain nothing from others
            done = done.union(placed if saved else earlier)
            break
        done, earlier, sequences = done.union(placed.where(~loose)), again, now_loose
        left, number, round_number = again.drop("sequence_id", "offset", "free"), left_over, round_number + 1
    return done.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
