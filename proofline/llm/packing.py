"""Packing: concatenate the token ids of all documents and cut them at fixed windows.

Two passes: the first encodes and keeps ids with running totals inside each partition; a prefix sum over the partition
totals gives every document its global offset; the second cuts at the windows and writes a record per piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import cut
from ._text import on_batches
from .bpe import binary, coder, forget, slices

CODED = "doc_id long, _part int, _at long, _n long, _ids binary"
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, end_id: int) -> DataFrame:
    """Ids of every text and their place within the partition; ids under 2^16 are kept in two bytes each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part, at = coder(tokenizer), TaskContext.get().partitionId(), 0
        for batch, texts in slices(batches, "_text"):
            ids, ends = known.encode(texts, end_id)
            sizes = np.diff(ends, prepend=0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.full(len(ends), part, np.int32)), pa.array(at + ends - sizes), pa.array(sizes), binary(ids, ends)],
                ["doc_id", "_part", "_at", "_n", "_ids"])
            at += int(ends[-1])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    return cut(on_batches(rows, run, CODED), "ids")


def pack(docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``, ``ids``.

    Every document is its ids and then ``end_id``; a NULL or empty text is ``end_id`` alone. Documents are laid end to end
    in the order the partitions hold them and cut at every ``window`` ids, so only the last sequence is short. Rows that repeat an id
    are documents of their own; a NULL id stays NULL. An empty table gives no piece. ``ids`` is little-endian, four bytes each.

    Each text is encoded once; its ids go to a written table, so a lost executor costs the encoding of its own
    partitions, and positions never change. Nothing is shuffled but one total per partition, which is also all that is broadcast.
    """
    coded = encode_documents(docs, tokenizer, id_col, text_col, end_id)
    totals = coded.groupBy("_part").agg(F.sum("_n").alias("_sum"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).cast("long").alias("_base"))
    placed = coded.join(F.broadcast(bases), "_part")  # one row per partition

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()  # all texts are encoded by now
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            at = batch.column("_at").to_numpy() + batch.column("_base").to_numpy()
            n = batch.column("_n").to_numpy()
            out: list[list] = [[] for _ in range(8)]
            for i, blob in enumerate(batch.column("_ids")):
                kept = np.frombuffer(blob.as_buffer(), "<u2" if len(blob.as_buffer()) == 2 * n[i] else "<u4").astype("<u4")
                begin, stop = int(at[i]), int(at[i] + n[i])
                while begin < stop:
                    end = min(stop, (begin // window + 1) * window)
                    raw = kept[begin - int(at[i]):end - int(at[i])].tobytes()
                    for column, v in zip(out, (ids[i], begin - int(at[i]), end - begin, zlib.crc32(raw), int(n[i]), begin // window, begin % window, raw)):
                        column.append(v)
                    begin = end
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(c, pa.int64()) for c in out[:7]], pa.array(out[7], pa.binary())],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])
    return on_batches(placed.select("doc_id", "_at", "_n", "_ids", "_base"), run, PIECES)
