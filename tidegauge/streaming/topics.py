"""Topics as numbered messages in a shared folder: appended whole batch by batch, read from any offset, in batch or as a stream.

A batch of messages is written as files by topic. One manifest per batch then says which
offsets each file holds; it appears by a rename, so that all topics of a batch appear at once,
and a batch that is appended again changes nothing. There is one writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Mapping, Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tidegauge.schema import ALL
from tidegauge.streaming.batches import Folder

FORMAT = "topic_log"
SCHEMA = "topic string, offset bigint, message string, ingest_ms bigint"
LOG, NUMBER = "log", 12


def _manifests(log: Folder) -> list[dict]:
    return [json.loads(log.read_text(n)) for n in log.names() if n.endswith(".json")]


def _ends(manifests: Sequence[Mapping]) -> dict[str, int]:
    return {topic: first + count for m in manifests for topic, _, first, count in m["segments"]}


def topic_ends(spark: SparkSession, path: str) -> dict[str, int]:
    """The offset after the last message of each topic, which is where ``latest`` starts."""
    return _ends(_manifests(Folder(spark, f"{path}/{LOG}")))


def append_messages(messages: DataFrame, path: str, name: str) -> bool:
    """Append topic, message and, if there, ingest_ms as batch ``name``; says whether it did.

    Offsets of a topic go on where its last batch ended. Rows without a topic belong
    to none and are left out. Only one row per written file comes to the driver.
    """
    spark = messages.sparkSession
    data, log = Folder(spark, f"{path}/data"), Folder(spark, f"{path}/{LOG}")
    written = _manifests(log)
    if any(m["batch"] == name for m in written):
        return False
    ends = _ends(written)
    ingest = F.col("ingest_ms") if "ingest_ms" in messages.columns else F.lit(None)
    rows = messages.where(F.col("topic").isNotNull()).select(
        "topic", F.col("message").cast("string"), ingest.cast("bigint").alias("ingest_ms"), F.col("topic").alias("_folder")
    )
    pending = f"_pending-{uuid.uuid4().hex}"
    if not data.has(name):
        rows.write.partitionBy("_folder").parquet(data.at(pending))
        data.publish(pending, name)
    back = spark.read.schema("topic string, message string").option("recursiveFileLookup", True).parquet(data.at(name))
    files = back.groupBy("topic", F.col("_metadata.file_path").alias("file")).count().orderBy("topic", "file").collect()
    segments = []
    for topic, file, count in files:
        below = "/".join(unquote(part) for part in file.split("/")[-2:])
        segments.append([topic, f"data/{name}/{below}", ends.get(topic, 0), count])
        ends[topic] = ends.get(topic, 0) + count
    log.write_text(f"{len(written):0{NUMBER}d}.json", json.dumps({"batch": name, "segments": segments}))
    return True


class Segment(InputPartition):
    """Messages from offset ``start`` up to ``end`` of a topic, in a file of the log whose first message has offset ``first``."""

    def __init__(self, path: str, topic: str, file: str, first: int, start: int, end: int):
        super().__init__((path, topic, file, first, start, end))


def _open(path: str):
    """The file system of a path or URI, and the path within it."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


class _Log:
    """The manifests of a folder; each is read once."""

    def __init__(self, path: str, topics: Sequence[str]):
        self.path, self.topics = path, set(topics)
        self.seen: set[str] = set()
        self.segments: dict[str, list[tuple[str, int, int]]] = {}

    def ends(self) -> dict[str, int]:
        from pyarrow import fs

        files, root = _open(f"{self.path}/{LOG}")
        listed = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
        for info in sorted((i for i in listed if i.base_name.endswith(".json") and i.base_name not in self.seen), key=lambda i: i.base_name):
            with files.open_input_stream(info.path) as stream:
                manifest = json.loads(stream.read())
            self.seen.add(info.base_name)
            for topic, file, first, count in manifest["segments"]:
                if not self.topics or topic in self.topics:
                    self.segments.setdefault(topic, []).append((file, first, first + count))
        return {topic: own[-1][2] for topic, own in self.segments.items()}

    def between(self, start: Mapping[str, int], end: Mapping[str, int]) -> list[Segment]:
        self.ends()
        return [
            Segment(self.path, topic, file, first, max(first, start.get(topic, 0)), min(last, upto))
            for topic, upto in end.items()
            for file, first, last in self.segments.get(topic, [])
            if max(first, start.get(topic, 0)) < min(last, upto)
        ]


def admitted(position: Mapping[str, int], ends: Mapping[str, int], most: int) -> dict[str, int]:
    """Where a batch of about ``most`` messages ends: topics share it by what they have waiting, one message at least."""
    waiting = {t: max(0, end - position.get(t, 0)) for t, end in ends.items()}
    total = sum(waiting.values())
    if total <= most:
        return {t: max(end, position.get(t, 0)) for t, end in ends.items()}
    return {t: position.get(t, 0) + min(w, max(1, most * w // total)) for t, w in waiting.items()}


def _read(segment: Segment) -> Iterator:
    import pyarrow as pa
    import pyarrow.parquet as pq

    path, topic, file, first, start, end = segment.value
    files, root = _open(path)
    with files.open_input_file(f"{root}/{file}") as source:
        parquet = pq.ParquetFile(source)
        groups, at = [], first
        begin = None
        for g in range(parquet.num_row_groups):
            rows = parquet.metadata.row_group(g).num_rows
            if at < end and at + rows > start:
                begin = at if begin is None else begin
                groups.append(g)
            at += rows
        at = begin
        for batch in parquet.iter_batches(row_groups=groups, columns=["message", "ingest_ms"]):
            low, high = max(start - at, 0), min(end - at, batch.num_rows)
            if low < high:
                offsets = pa.array(range(at + low, at + high), pa.int64())
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([topic] * len(part), pa.string()), offsets, part.column("message").cast(pa.string()), part.column("ingest_ms")],
                    names=["topic", "offset", "message", "ingest_ms"],
                )
            at += batch.num_rows


class TopicStream(DataSourceStreamReader):
    """Offsets are a number per topic: how many of its messages have been read."""

    def __init__(self, options: Mapping[str, str]):
        self.log = _Log(options["path"], json.loads(options.get("topics", "[]")))
        self.starting = options.get("starting", "earliest")
        self.most = int(options.get("most", 0))
        self.positions = options.get("positions")
        if self.most and not self.positions:
            raise ValueError("a limit needs positions, a folder in which a restarted stream finds where it was")
        self.start: dict[str, int] | None = None
        self.position: dict[str, int] | None = None

    def _first(self) -> dict[str, int]:
        """Where a new stream begins, looked up once: it may be asked for its end before its beginning."""
        if self.start is None:
            if self.starting == "latest":
                self.start = self.log.ends()
            else:
                self.start = {} if self.starting == "earliest" else {t: int(n) for t, n in json.loads(self.starting).items()}
                ends = self.log.ends()
                beyond = sorted(t for t, n in self.start.items() if not 0 <= n <= ends.get(t, 0))
                if beyond:
                    raise ValueError(f"these topics have no such offset: {beyond}")
        return self.start

    def initialOffset(self) -> dict:
        self._plan(self._first())
        return self._first()

    def latestOffset(self) -> dict:
        if not self.most:
            self._first()
            return self.log.ends()
        if self.position is None:
            files, root = _open(self.positions)
            if files.get_file_info(f"{root}/position.json").is_file:
                with files.open_input_stream(f"{root}/position.json") as stream:
                    self.position = json.loads(stream.read())
            else:
                self.position = dict(self._first())
        return {**self.position, **admitted(self.position, self.log.ends(), self.most)}

    def _plan(self, end: Mapping[str, int]) -> None:
        """Remember where the batch that is being planned ends: a restarted stream goes on from there, after that batch."""
        self.position = dict(end)
        if self.most:
            files, root = _open(self.positions)
            files.create_dir(root, recursive=True)
            pending = f"{root}/_{uuid.uuid4().hex}"
            with files.open_output_stream(pending) as out:
                out.write(json.dumps(self.position).encode())
            files.move(pending, f"{root}/position.json")

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self._plan(end)
        return self.log.between(start, end)

    def read(self, partition: InputPartition) -> Iterator:
        return _read(partition)


class TopicTable(DataSourceReader):
    """All messages there are when the read is planned, from ``starting`` on."""

    def __init__(self, options: Mapping[str, str]):
        self.stream = TopicStream({k: options[k] for k in ("path", "topics", "starting") if k in options})

    def partitions(self) -> Sequence[InputPartition]:
        start = self.stream.initialOffset()
        return self.stream.log.between(start, self.stream.log.ends())

    def read(self, partition: InputPartition) -> Iterator:
        return _read(partition) if partition is not None else iter(())


class TopicSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TopicTable(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TopicStream(self.options)


def read_topics(
    spark: SparkSession,
    path: str,
    topics: Sequence[str] | None = None,
    *,
    starting: str | Mapping[str, int] = "earliest",
    most: int = 0,
    positions: str | None = None,
    streaming: bool = False,
) -> DataFrame:
    """topic, offset, message, ingest_ms of the topics in ``path`` (all of them, if none or ``ALL`` is named).

    ``starting``: earliest, latest, or the first offset of each topic (0 for topics that are not named). A stream
    starts there once and then goes on from its checkpoint; topics that appear later are read from their beginning.
    ``most``: about how many messages a micro-batch takes, shared by what the topics have waiting; a trigger that ends
    by itself runs one such batch. It needs ``positions``, a folder of the stream's own. ``path`` must be one that
    pyarrow can open (a folder that all executors share, or a URI).
    """
    spark.dataSource.register(TopicSource)
    reader = (spark.readStream if streaming else spark.read).format(FORMAT)
    reader = reader.option("path", path).option("topics", json.dumps([] if not topics or ALL in topics else list(topics)))
    reader = reader.option("starting", starting if isinstance(starting, str) else json.dumps(dict(starting)))
    if most:
        reader = reader.option("most", str(most))
    if positions:
        reader = reader.option("positions", positions)
    return reader.load()
