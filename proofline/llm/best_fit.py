"""Best-fit packing with bounded space: a fixed number of open bins in a bitset keyed by free space; the fullest closes first.

Each task packs the documents it reads as they come and passes on the pieces of every bin that closes. What lies in bins that
are still open when a task ends is packed again, over a few partitions at a time, largest piece first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import cut
from ._text import on_batches
from .bpe import coder, slices

OPEN = 1024  # bins a task keeps open
TOGETHER = 4  # partitions whose open bins are packed again by one task
FLUSH = 1 << 22  # bytes of ids that are passed on at a time
PIECES = ("doc_id long, piece int, start long, length long, ids_crc32 long, doc_tokens long, _part long, _no long, _bin long, offset long, "
          "_open boolean, ids binary")
MOVED = "_part long, _no long, sequence_id long, offset long"


class Bins:
    """At most ``most`` open bins of ``size``, found by free space in a bitset."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.free, self.by_free, self.n_open, self.made = size, most, 0, {}, 0, 0

    def _take(self, room: int) -> int:
        bins = self.by_free[room]
        taken = bins.pop()
        if not bins:
            del self.by_free[room]
            self.free &= ~(1 << room)
        self.n_open -= 1
        return taken

    def place(self, n: int) -> tuple[int, int, list[int]]:
        """The bin and the offset for ``n`` tokens, and the bins this has closed.

        The open bin with the least room that suffices takes them. If none has, a new bin does; where that would be one too
        many, the fullest closes.
        """
        closed: list[int] = []
        if n == self.size:
            self.made += 1
            return self.made - 1, 0, [self.made - 1]
        fitting = self.free >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            taken = self._take(room)
        else:
            if self.n_open == self.most:
                closed.append(self._take((self.free & -self.free).bit_length() - 1))
            taken, room = self.made, self.size
            self.made += 1
        left = room - n
        if left:
            self.by_free.setdefault(left, []).append(taken)
            self.free |= 1 << left
            self.n_open += 1
        else:
            closed.append(taken)
        return taken, self.size - room, closed

    def rest(self) -> list[int]:
        """The bins that are open."""
        return sorted(b for bins in self.by_free.values() for b in bins)


def _cuts(n: int, size: int) -> list[tuple[int, int]]:
    """Start and length of each piece of ``n`` tokens; only the first may be shorter than ``size``."""
    first = n % size or size
    return [(0, first), *((s, size) for s in range(first, n, size))]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 8, pa.bool_(), pa.binary()]
    names = [field.split()[0] for field in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names)


def best_fit(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text",
             most_open: int = OPEN) -> DataFrame:
    """One row per piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``, ``ids``.

    Every document is its ids and then ``end_id``; a NULL or empty text is ``end_id`` alone. Documents of up to ``size`` ids stay
    whole; longer ones are cut into pieces of ``size``, of which only the first may be shorter. Pieces of one sequence lie end to
    end from 0. Rows that repeat an id are documents of their own; a NULL id stays NULL. An empty table gives no piece. ``ids``
    is little-endian, two bytes each where the tokenizer has at most 2^16 ids, else four; ``ids_crc32`` is that of four bytes each.
    Only ``id_col`` and ``text_col`` are read, so other columns may have any name.

    A text of any length is encoded whole, by one task. The pieces of each slice of documents that is encoded together arrive
    largest first, at bins that earlier slices left open. A task holds the ids of at most ``most_open`` bins and of one slice. Only
    the sizes of pieces in bins that stayed open move between tasks, and their ids where ``ids`` is asked for.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part, bins, held, number = coder(tokenizer), TaskContext.get().partitionId(), Bins(size, most_open), {}, 0
        out, weight = [], 0

        def row(place: tuple, is_open: bool) -> tuple:
            doc, piece, start, n, crc, total, no, taken, offset, raw = place
            return doc, piece, start, n, crc, total, part, no, taken, offset, is_open, raw

        for batch, texts in slices(batches, "_text"):
            ids, ends = known.encode(texts, end_id)
            docs_here = batch.column("doc_id").to_pylist()
            pieces, begin = [], 0
            for doc, end in zip(docs_here, ends.tolist()):
                pieces += [(n, doc, i, begin, start, end - begin) for i, (start, n) in enumerate(_cuts(end - begin, size))]
                begin = end
            pieces.sort(key=lambda p: -p[0])
            for n, doc, i, begin, start, total in pieces:
                some = ids[begin + start:begin + start + n]
                taken, offset, closed = bins.place(n)
                held.setdefault(taken, []).append((doc, i, start, n, zlib.crc32(some.astype("<u4")), total, number, taken, offset, some.tobytes()))
                number += 1
                for done in closed:
                    for place in held.pop(done):
                        out.append(row(place, False))
                        weight += len(place[-1])
                if weight >= FLUSH:
                    yield _rows(out)
                    out, weight = [], 0
        for left in bins.rest():
            out += [row(place, True) for place in held.pop(left)]
            if len(out) >= 4096:
                yield _rows(out)
                out = []
        yield _rows(out)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    placed = cut(on_batches(rows, run, PIECES), "pieces")

    def again(pieces: pa.Table) -> pa.Table:
        part, number, n = (pieces.column(c).to_numpy() for c in ("_part", "_no", "length"))
        order = np.lexsort((number, part, -n))
        bins, group = Bins(size, len(n)), int(part[0]) // TOGETHER  # none has to close
        found = [bins.place(k)[:2] for k in n[order].tolist()]
        taken, offset = np.array(found, np.int64).T
        return pa.table([pa.array(part[order]), pa.array(number[order]), pa.array(-1 - ((group << 32) + taken)), pa.array(offset)],
                        ["_part", "_no", "sequence_id", "offset"])

    left = placed.filter("_open")
    moved = cut(left.select("_part", "_no", "length").groupBy(F.floor(F.col("_part") / TOGETHER)).applyInArrow(again, MOVED), "moved")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    closed = placed.filter("not _open").withColumn("sequence_id", F.col("_part") * (1 << 32) + F.col("_bin"))
    return closed.select(names).unionByName(left.drop("offset").join(moved, ["_part", "_no"]).select(names))
