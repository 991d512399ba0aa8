"""Packing documents into sequences: best fit, then a swap-based local search."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickline.llm import tokens
from wickline.llm import words as W
from wickline.llm.scratch import batches_of, written

GROUP_PIECES = 8_000
GAIN = 0.99
LEVELS = 30
ENCODE_BYTES = 2 << 20

def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Items in decreasing order, each into the bin it leaves least room in."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0  # bit r: a bin with r places left exists
    for i in sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True):
        size = lengths[i]
        fitting = some >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                some &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        left = room - size
        by_room[left].append(b)
        some |= 1 << left
    return bins


class LocalSearch:
    """Shifts room from fuller bins into emptier ones until bins are empty.

    Every underfull bin is in turn the donor, the least full first; receivers are the
    underfull bins at least as full. A step moves a document, swaps one for a smaller
    one, or two for one smaller than both; the receiver gains as many tokens as the
    donor loses, so the sum of squared fills grows with each step and the search ends.
    A step takes the receiver that is left with least room. It stops as soon as fewer
    bins are impossible, or when no donor has a step left.
    """

    def __init__(self, bins: list[list[int]], lengths: list[int], capacity: int):
        self.size, self.capacity = np.array(lengths, np.int64), capacity
        self.bins = [list(b) for b in bins]
        self.bin_of = np.empty(len(lengths), np.int64)
        for b, items in enumerate(self.bins):
            self.bin_of[items] = b
        self.fill = np.bincount(self.bin_of, self.size, len(bins)).astype(np.int64)

    def _shift(self, given: list[int], donor: int, to: int) -> None:
        for i in given:
            self.bins[donor].remove(i)
            self.bins[to].append(i)
            self.bin_of[i] = to
            self.fill[donor] -= self.size[i]
            self.fill[to] += self.size[i]

    def _step(self, donor: int) -> bool:
        """One step from the donor, if there is one."""
        room = self.capacity - self.fill
        takes = (room > 0) & (self.fill >= self.fill[donor])
        takes[donor] = False
        receivers = np.flatnonzero(takes)
        if not len(receivers):
            return False
        mine = sorted(self.bins[donor], key=self.size.__getitem__, reverse=True)
        for i in mine:
            fits = receivers[room[receivers] >= self.size[i]]
            if len(fits):
                self._shift([i], donor, int(fits[np.argmin(room[fits])]))
                return True
        held = np.flatnonzero(takes[self.bin_of])
        held_size, held_room = self.size[held], room[self.bin_of[held]]
        singles = {int(self.size[i]): [i] for i in mine}
        pairs = {int(self.size[i] + self.size[j]): [i, j] for n, i in enumerate(mine) for j in mine[:n]}
        for offers in (singles, pairs):
            for total, given in offers.items():
                gain = total - held_size
                good = np.flatnonzero((gain > 0) & (gain <= held_room))
                if len(good):
                    back = int(held[good[np.argmin(held_room[good] - gain[good])]])
                    to = int(self.bin_of[back])
                    self._shift(given, donor, to)
                    self._shift([back], to, donor)
                    return True
        return False

    def run(self) -> list[list[int]]:
        least, count, moved = -(-int(self.size.sum()) // self.capacity), len(self.bins), True
        while moved and count > least:
            moved = False
            underfull = np.flatnonzero((self.fill > 0) & (self.fill < self.capacity))
            for donor in underfull[np.argsort(self.fill[underfull], kind="stable")].tolist():
                while self.bins[donor] and self._step(donor):
                    moved = True
                if not self.bins[donor]:
                    count -= 1
                    if count == least:
                        break
        return [b for b in self.bins if b]


def pack(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers; every item is in one, no bin is over ``capacity``."""
    return LocalSearch(best_fit(lengths, capacity), lengths, capacity).run()


def _tokenise(name: str, capacity: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(name).encode
        for batch in batches:
            for part, texts in W.pieces(batch, "text", ENCODE_BYTES):
                out = []
                for row, ids in enumerate(encode(texts.to_pylist())):
                    ids += end
                    for k, start in enumerate(range(0, len(ids) // 4, capacity)):
                        piece = ids[4 * start : 4 * (start + capacity)]
                        out.append((row, k, start, len(piece) // 4, zlib.crc32(piece)))
                row, *values = zip(*out)
                kept = part.select(["row_id", "id"]).take(pa.array(row))
                columns = [pa.array(v, t) for v, t in zip(values, (pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([*kept.columns, *columns], names=["row_id", "id", "piece", "start", "length", "ids_crc32"])

    return run


def _packer(capacity: int, level: int):
    """One group's pieces into sequences; those that have room are open."""

    def run(table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_pylist()
        group = table.column("group")[0].as_py()
        bins = pack(lengths, capacity)
        sequence, offset, is_open = ([0] * len(lengths) for _ in range(3))
        for b, items in enumerate(bins):
            at, has_room = 0, int(sum(lengths[i] for i in items) < capacity)
            for i in items:
                sequence[i], offset[i], is_open[i] = level << 58 | group << 24 | b, at, has_room
                at += lengths[i]
        added = {"sequence_id": sequence, "offset": offset, "open": is_open}
        for name, values in added.items():
            table = table.append_column(name, pa.array(values, pa.int64()))
        return table.drop_columns(["group"])

    return run


def pack_pieces(pieces: DataFrame, capacity: int, key: list[str], group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``pieces`` (a written table with ``length`` and the ``key`` columns) with
    ``sequence_id`` and ``offset``.

    Each level packs groups of about ``group_pieces`` pieces, dealt anew by a hash of
    the key, so a task holds a bounded number at any input size. Full sequences are
    final; the pieces of all others, whatever their number, go on to the next level,
    where they meet those of other groups. It ends with one group, when fewer sequences
    are impossible, or when a level neither had fewer groups to pack nor left at least
    1 % fewer sequences with room than the one before: what is left can't be combined.
    """
    groups, level, done, before = max(1, -(-pieces.count() // group_pieces)), 0, [], None
    todo = pieces
    while True:
        todo = todo.withColumn("group", F.pmod(F.xxhash64(F.lit(level), *key), F.lit(groups)))
        schema = ", ".join(f"`{n}` {t}" for n, t in todo.drop("group").dtypes) + ", sequence_id long, offset long, open long"
        packed = written(todo.groupBy("group").applyInArrow(_packer(capacity, level), schema), "packed")
        left = packed.filter("open = 1")
        n, bins, size = left.agg(F.count("*"), F.count_distinct("sequence_id"), F.coalesce(F.sum("length"), F.lit(0))).first()
        fewer = max(1, -(-n // group_pieces))
        stuck = before is not None and fewer >= groups and bins > GAIN * before
        if groups == 1 or bins <= -(-size // capacity) or stuck or level == LEVELS:
            done.append(packed)
            break
        done.append(packed.filter("open = 0"))
        todo, groups, level, before = left.drop("sequence_id", "offset", "open"), fewer, level + 1, bins
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.drop("open")


def pack_documents(
    df: DataFrame,
    capacity: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = tokens.WORD_BPE,
    end_id: int = 1,
) -> DataFrame:
    """One row per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32``,
    ``sequence_id``, ``offset``.

    A document's ids end with ``end_id``; one longer than ``capacity`` is cut into
    pieces of ``capacity``, the last may be shorter. Null and empty texts are the end
    id alone. Repeated rows are documents of their own. An empty table gives an empty
    result; other columns aren't looked at.
    """
    rows = df.select(
        F.monotonically_increasing_id().alias("row_id"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")
    )
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"row_id long, id {kind}, piece int, start long, length long, ids_crc32 long"
    with batches_of(df.sparkSession):
        pieces = written(rows.mapInArrow(_tokenise(tokenizer, capacity, end_id), schema), "pieces")
    packed = pack_pieces(pieces, capacity, ["row_id", "piece"])
    return packed.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
