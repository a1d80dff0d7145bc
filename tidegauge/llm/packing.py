"""Packing documents into sequences of a fixed number of tokens by bounded-space best fit.

Texts become token ids once. Only the lengths and checksums of the pieces are
dealt over tasks, each of which packs its own pieces as they come, longest first.
A task keeps a fixed number of open sequences, found by free space in a bitset;
a piece goes where it leaves the least room, and when one more must be opened
the fullest is closed. A place is final when given, so rows stream through.

Cases: a null text is empty and still has its end token; repeated rows are packed
each; a text of any length is cut into pieces and nothing is dropped; an empty
table gives no row; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.common import cut, map_arrow, query, table
from tidegauge.llm.tokenize import default_path, encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of each document: doc_id, piece, start, length, ids_crc32. Only longer ones than ``capacity`` are cut."""
    end, step = end_id.to_bytes(4, "little"), 4 * capacity

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32

        ids_of = encoder(tokenizer)
        for batch in batches:
            keys, rows = batch.column(0).to_pylist(), []
            for begin in range(0, len(keys), 512):
                texts = batch.column(1).slice(begin, 512).to_pylist()
                for doc, value in zip(keys[begin : begin + 512], texts):
                    ids = ids_of(value or "") + end
                    for at in range(0, len(ids), step):
                        part = ids[at : at + step]
                        rows.append((doc, at // step, at // 4, len(part) // 4, crc32(part)))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return map_arrow(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), pieces, PIECES)


class OpenBins:
    """Open sequences by free space. ``spaces`` has bit f set where some open sequence has f free."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.spaces, self.open, self.made = 0, 0, 0
        self.by_space: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, space: int) -> int:
        bins = self.by_space[space]
        found = bins.pop()
        if not bins:
            self.spaces &= ~(1 << space)
        self.open -= 1
        return found

    def _put(self, number: int, space: int) -> None:
        self.by_space[space].append(number)
        self.spaces |= 1 << space
        self.open += 1

    def place(self, length: int) -> tuple[int, int]:
        """Number of the sequence and the offset in it."""
        fitting = self.spaces >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            number = self._take(space)
        else:
            if self.open >= self.most:
                self._take((self.spaces & -self.spaces).bit_length() - 1)
            number, space = self.made, self.capacity
            self.made += 1
        if space > length:
            self._put(number, space - length)
        return number, self.capacity - space


def best_fit(pieces: DataFrame, capacity: int = 2048, open_bins: int = 4096, sequences_per_task: int = 16384) -> DataFrame:
    """Adds sequence_id and offset to rows with ``length``; rows must be dealt and recomputed alike (a written table).

    Tasks: as many as the total length needs at ``sequences_per_task`` each; every
    task leaves a few sequences part empty, so that more tasks would waste more.
    """
    total = pieces.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-total // (capacity * sequences_per_task)))
    names = pieces.columns

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, first = OpenBins(capacity, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            places = [bins.place(n) for n in batch.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([first + n for n, _ in places], pa.int64()), pa.array([at for _, at in places], pa.int64())],
                names=[*names, "sequence_id", "offset"],
            )

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    dealt = pieces.repartition(tasks, F.xxhash64(*names)).sortWithinPartitions(F.desc("length"), *[n for n in names if n != "length"])
    return map_arrow(dealt, pack, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, open_bins: int = 4096) -> DataFrame:
    return best_fit(cut(token_pieces(docs, tokenizer, capacity)), capacity, open_bins)


@query("op2_packing")
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), default_path())
