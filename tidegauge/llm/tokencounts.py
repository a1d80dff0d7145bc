"""Token counts by a separator scan over flat, unindexed token files.

A token file is nothing but ids, one document after the other, each followed by
the separator; nothing says where a document begins. Tasks read ranges of its bytes,
in blocks of a fixed length that know nothing of each other. Each block is searched for
the separator at once (numpy), and gives its number of ids and the places of its
separators. What a block cannot know, where it begins in its file, how many
documents ended before and where the last one ended, comes from a prefix scan over
the blocks: first inside runs of RUN blocks, then over the runs, so that no task
holds all blocks of a file. With it, the place of every separator gives a document,
also one that spans many blocks.

Cases: an empty or null text has no token but the separator and counts 0; a text
of any length spans as many blocks as it needs; what follows the last separator of
a file is a document that is not closed; an empty file or table gives no row;
repeated rows are documents of their own; further columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import map_arrow, query, shared_folder, table
from tidegauge.llm.tokenize import default_path, encoder

#: Ids of a block and blocks of a run; ids are unsigned with WIDTH bytes.
BLOCK_IDS, RUN, WIDTH = 8192, 1024, 2
#: Bytes that one task reads, and blocks that it reads at a time.
TASK_BYTES, READ = 64 << 20, 64
#: First id that the vocabulary does not use.
SEPARATOR = 49408


def token_blocks(docs: DataFrame, tokenizer: str, separator: int = SEPARATOR, key: str = "doc_id", text: str = "text") -> DataFrame:
    """file, block, data, ended: the flat ids of each task's documents, cut into blocks wherever these end.

    ``ended`` lists the documents whose separator lies in the block. It is not
    needed to find them, only to name them.
    """
    size = BLOCK_IDS * WIDTH
    end = separator.to_bytes(WIDTH, "little")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, file, block = encoder(tokenizer), TaskContext.get().partitionId(), 0
        held, ended = bytearray(), []

        def rows(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal block
            while len(held) >= size or last and held:
                # documents end in the order in which their separators lie
                here = bytes(held[:size])
                n = int((np.frombuffer(here, f"<u{WIDTH}") == separator).sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file], pa.int32()), pa.array([block], pa.int64()), pa.array([here], pa.binary()), pa.array([ended[:n]], pa.list_(pa.int64()))],
                    names=["file", "block", "data", "ended"],
                )
                del held[:size], ended[:n]
                block += 1

        for batch in batches:
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held += np.frombuffer(ids_of(value or ""), "<u4").astype(f"<u{WIDTH}").tobytes() + end
                ended.append(doc)
            yield from rows(False)
        yield from rows(True)

    chosen = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_arrow(chosen, write, "file int, block long, data binary, ended array<long>")


def _files(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder or file that all executors share, and its path there."""
    local = re.match(r"file:/*(/.*)", uri)
    if local or ":/" not in uri:
        return pafs.LocalFileSystem(), local[1] if local else uri
    return pafs.FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, separator: int = SEPARATOR, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the ids of ``docs`` as flat files, one for each task, and apart from them which document is which.

    The files, ``folder/ids/<task>-<attempt>.bin``, hold nothing but ids and
    separators. Result, read from ``folder/names``: file (its name), part (its
    task), ordinal, doc_id. A file that a task left behind when it failed is in no
    row of it.
    """
    end = separator.to_bytes(WIDTH, "little")
    files, path = _files(f"{folder}/ids")
    files.create_dir(path, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part = encoder(tokenizer), TaskContext.get().partitionId()
        name, ordinal, out = f"{part:06d}-{uuid.uuid4().hex}.bin", 0, None
        own_files, own_path = _files(f"{folder}/ids")
        try:
            for batch in batches:
                if out is None and batch.num_rows:
                    out = own_files.open_output_stream(f"{own_path}/{name}")
                for value in batch.column(1).to_pylist():
                    out.write(np.frombuffer(ids_of(value or ""), "<u4").astype(f"<u{WIDTH}").tobytes() + end)
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * n, pa.string()), pa.array([part] * n, pa.int32()), pa.array(np.arange(ordinal, ordinal + n)), batch.column(0)],
                    names=["file", "part", "ordinal", "doc_id"],
                )
                ordinal += n
        finally:
            if out is not None:
                out.close()

    chosen = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    map_arrow(chosen, write, "file string, part int, ordinal long, doc_id long").write.parquet(f"{folder}/names")
    return docs.sparkSession.read.parquet(f"{folder}/names")


def file_blocks(spark: SparkSession, path: str) -> DataFrame:
    """file, block, data of the flat token files of any size under ``path``.

    Files are cut into runs of RUN blocks by their length alone; the tasks, which
    are dealt runs, read the bytes of one run after the other.
    """
    size = BLOCK_IDS * WIDTH
    listed = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length").filter("length > 0")
    runs = listed.select("file", "length", F.explode(F.expr(f"sequence(0L, (length - 1) div {size * RUN})")).alias("run"))
    tasks = max(spark.sparkContext.defaultParallelism, -(-(listed.agg(F.sum("length")).first()[0] or 0) // TASK_BYTES))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, length, run in zip(*(c.to_pylist() for c in batch.columns)):
                files, own = _files(name)
                with files.open_input_file(own) as source:
                    end = min((run + 1) * RUN * size, length)
                    for block in range(run * RUN, -(-end // size), READ):
                        data = source.read_at(min(READ * size, end - block * size), block * size)
                        here = [data[i : i + size] for i in range(0, len(data), size)]
                        numbers = np.arange(block, block + len(here))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([name] * len(here), pa.string()), pa.array(numbers), pa.array(here, pa.binary())], names=["file", "block", "data"]
                        )

    spread = runs.repartition(tasks, F.xxhash64("file", "run"))
    return spread.mapInArrow(read, "file string, block long, data binary")


def separators(blocks: DataFrame, separator: int = SEPARATOR) -> DataFrame:
    """file, block, n_ids, places (of the separators in the block) and the other columns; the data are not passed on."""
    also = [c for c in blocks.columns if c not in ("file", "block", "data")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2).cast(pa.large_binary())
            borders = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            ids = np.frombuffer(column.buffers()[2] or b"", np.uint8)[borders[0] : borders[-1]].view(f"<u{WIDTH}")
            at = (borders - borders[0]) // WIDTH
            hit = np.flatnonzero(ids == separator)
            first = np.searchsorted(hit, at)
            places = hit - np.repeat(at[:-1], np.diff(first))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(np.diff(at)),
                    pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(places.astype(np.int32))),
                    *batch.columns[3:],
                ],
                names=["file", "block", "n_ids", "places", *also],
            )

    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema}
    more = "".join(f", {c} {kinds[c]}" for c in also)
    return map_arrow(blocks.select("file", "block", "data", *also), scan, f"file {kinds['file']}, block long, n_ids long, places array<int>{more}")


def stitched(scanned: DataFrame) -> DataFrame:
    """Adds to each block: start (ids before it in its file), before (documents ended before it), last (place of the
    separator before it in the file, -1 if none)."""
    last = F.when(F.size("places") > 0, F.try_element_at("places", F.lit(-1)))
    rows = scanned.withColumn("run", F.floor(F.col("block") / RUN)).withColumn("n_ends", F.size("places").cast("long"))
    inside = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
    rows = rows.withColumn("before", F.coalesce(F.sum("n_ends").over(inside), F.lit(0))).withColumn("own_last", F.col("start") + last)
    rows = rows.withColumn("last", F.max("own_last").over(inside))
    runs = rows.groupBy("file", "run").agg(
        F.sum("n_ids").alias("run_ids"), F.sum("n_ends").alias("run_ends"), F.max("own_last").alias("run_last"), F.max("block").alias("run_block")
    )
    along = Window.partitionBy("file").orderBy("run")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("run_start", F.coalesce(F.sum("run_ids").over(earlier), F.lit(0)))
    runs = runs.withColumn("run_before", F.coalesce(F.sum("run_ends").over(earlier), F.lit(0)))
    runs = runs.withColumn("run_earlier", F.max(F.col("run_start") + F.col("run_last")).over(earlier))
    runs = runs.withColumn("file_block", F.max("run_block").over(Window.partitionBy("file")))
    carried = runs.select("file", "run", "run_start", "run_before", "run_earlier", "file_block")
    joined = rows.join(carried, ["file", "run"])
    return joined.select(
        *scanned.columns,
        (F.col("run_start") + F.col("start")).alias("start"),
        (F.col("run_before") + F.col("before")).alias("before"),
        F.coalesce(F.col("run_start") + F.col("last"), F.col("run_earlier"), F.lit(-1).cast("long")).alias("last"),
        (F.col("block") == F.col("file_block")).alias("is_last"),
    )


def documents(blocks: DataFrame, separator: int = SEPARATOR, names: str | None = None) -> DataFrame:
    """file, ordinal, start, n_tokens, closed of every document in the files, and its name if blocks list them in ``names``."""
    rows = stitched(separators(blocks, separator))
    ends = F.transform("places", lambda p: F.col("start") + p)
    # a run of ids after the last separator of a file is a document without an end
    rest = F.col("is_last") & (F.coalesce(F.try_element_at(ends, F.lit(-1)), F.col("last")) + 1 < F.col("start") + F.col("n_ids"))
    ends_of = F.when(rest, F.concat(ends, F.array(F.col("start") + F.col("n_ids")))).otherwise(ends)
    rows = rows.withColumn("ends", F.when(F.size("places") > 0, ends_of).otherwise(F.when(rest, F.array(F.col("start") + F.col("n_ids")))))
    rows = rows.filter("ends is not null").withColumn("begins", F.concat(F.array("last"), F.slice("ends", F.lit(1), F.size("ends") - 1)))
    found = rows.select("file", "before", "places", "begins", "ends", *([names] if names else []), F.posexplode("ends").alias("number", "end"))
    begin = F.get("begins", F.col("number")) + 1
    return found.select(
        "file",
        (F.col("before") + F.col("number")).alias("ordinal"),
        begin.alias("start"),
        (F.col("end") - begin).alias("n_tokens"),
        (F.col("number") < F.size("places")).alias("closed"),
        *([F.get(names, F.col("number")).alias("name")] if names else []),
    )


@query("op8_tokencounts")
def op8_tokencounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    names = write_token_files(table(spark, sf_dir, "documents"), folder, default_path())
    found = documents(file_blocks(spark, f"{folder}/ids")).withColumn("file", F.regexp_extract("file", "[^/]+$", 0))
    # both sides grow with the documents, so that neither is sent whole to every task
    named = found.join(names.hint("merge"), ["file", "ordinal"])
    return named.select("doc_id", "n_tokens", F.col("part").alias("file"), "ordinal", "start", "closed")
