"""Tables that streams write batch by batch, once each, and versioned snapshots, on any file system that Spark reads.

A batch may be handed over again after a failure. What it writes goes to a hidden
folder first and takes its final name by a rename, only if that name is still free:
a replayed batch finds its folder and leaves it as it is, so that readers, streams
among them, see each batch whole and once.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

PENDING = "_pending"


class Folder:
    """A folder of a file system that Spark knows, by way of Hadoop's client."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._of = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._of(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def has(self, name: str) -> bool:
        return self._fs.exists(self._of(self.at(name)))

    def names(self) -> list[str]:
        if not self._fs.exists(self._of(self.path)):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._of(self.path)))

    def publish(self, pending: str, name: str) -> None:
        """Give a pending folder or file its final name; if another has it by now, that one stays."""
        if not self._fs.rename(self._of(self.at(pending)), self._of(self.at(name))) and not self.has(name):
            raise OSError(f"{self.at(pending)} could not be renamed to {name}")

    def remove(self, name: str) -> None:
        self._fs.delete(self._of(self.at(name)), True)

    def write_text(self, name: str, text: str) -> None:
        pending = f"{PENDING}-{uuid.uuid4().hex}"
        out = self._fs.create(self._of(self.at(pending)), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        self.publish(pending, name)

    def read_text(self, name: str) -> str:
        source = self._fs.open(self._of(self.at(name)))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode()
        finally:
            source.close()


def write_once(frame: DataFrame, path: str, name: str, fmt: str = "parquet") -> bool:
    """Write ``frame`` as the folder ``path/name`` unless that exists; says whether it wrote."""
    folder = Folder(frame.sparkSession, path)
    if folder.has(name):
        return False
    pending = f"{PENDING}-{uuid.uuid4().hex}"
    frame.write.format(fmt).save(folder.at(pending))
    folder.publish(pending, name)
    return True


def start_tee(
    frame: DataFrame,
    outlets: Mapping[str, Callable[[DataFrame], DataFrame]],
    path: str,
    checkpoint: str,
    fmt: str = "parquet",
    **trigger,
) -> StreamingQuery:
    """One query that reads its source once and feeds several outlets.

    Every micro-batch is written once to the shared folder (``path/_input``) and read
    from there by all outlets, so neither the source nor what precedes the tee runs
    again for each of them. An outlet's rows of a batch are the folder
    ``path/<outlet>/batch=<id>``; a batch that is handed over again after a failure
    between two outlets writes only those that lack. The input copy goes when all
    outlets are written. The trigger is ``availableNow`` unless given.
    """

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        name = f"batch={batch_id}"
        missing = [o for o in outlets if not Folder(spark, f"{path}/{o}").has(name)]
        if missing:
            write_once(batch, f"{path}/_input", name)
            rows = spark.read.schema(batch.schema).parquet(f"{path}/_input/{name}")
            for outlet in missing:
                write_once(outlets[outlet](rows), f"{path}/{outlet}", name, fmt)
        Folder(spark, f"{path}/_input").remove(name)

    writer = frame.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


class Snapshots:
    """A table in whole versions: folders ``v=<n>`` and a manifest per version, written last.

    Readers take the version of the highest manifest, which is complete when its
    manifest exists; writers add the next version beside it. A version names the
    batch that it holds, so that a replayed batch changes nothing. Versions older than
    ``keep`` are removed; a reader that started on one of the last ``keep`` is not disturbed.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 3):
        self.spark, self.folder, self.keep = spark, Folder(spark, path), max(2, keep)

    def _versions(self) -> list[int]:
        names = [n for n in self.folder.names() if n.startswith("manifest-") and n.endswith(".json")]
        return sorted(int(n[len("manifest-") : -len(".json")]) for n in names)

    def manifest(self) -> dict | None:
        """version and batch of the current version."""
        versions = self._versions()
        return json.loads(self.folder.read_text(f"manifest-{versions[-1]}.json")) if versions else None

    def read(self) -> DataFrame | None:
        """The current version; None if there is none yet."""
        current = self.manifest()
        return None if current is None else self.spark.read.parquet(self.folder.at(f"v={current['version']}"))

    def write(self, table: DataFrame, batch: int | None = None) -> int:
        """Make ``table``, which may be derived from the current version, the next one; its number."""
        current = self.manifest()
        if current is not None and batch is not None and current["batch"] is not None and current["batch"] >= batch:
            return current["version"]
        version = 0 if current is None else current["version"] + 1
        name = f"v={version}"
        if self.folder.has(name):  # data whose manifest was never written
            self.folder.remove(name)
        write_once(table, self.folder.path, name)
        self.folder.write_text(f"manifest-{version}.json", json.dumps({"version": version, "batch": batch}))
        for old in self._versions()[: -self.keep]:
            self.folder.remove(f"manifest-{old}.json")
            self.folder.remove(f"v={old}")
        return version


def merge_changes(table: DataFrame | None, changes: DataFrame, keys: Sequence[str], order: Sequence[str], deleted: str | None = None) -> DataFrame:
    """``table`` after a batch of ``changes``: of the rows of a key the last by ``order`` counts, and is dropped if it is ``deleted``.

    Changes of one order value are settled by their other columns, so that the result
    does not depend on how they arrive. A change older than the table's row loses; a
    deletion is forgotten once it is applied, so that any later batch may bring its key back.
    """
    columns = [c for c in changes.columns if c != deleted]
    rest = [c for c in columns if c not in (*keys, *order)]
    gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
    rows = changes.select(*columns, gone.alias("_gone"))
    if table is not None:
        rows = rows.unionByName(table.select(*columns, F.lit(False).alias("_gone")))
    last = F.max(F.struct(*order, "_gone", *rest)).alias("_last")
    found = rows.groupBy(*keys).agg(last).where("not _last._gone")
    return found.select(*[F.col(c) if c in keys else F.col("_last")[c].alias(c) for c in columns])


def start_upserts(
    changes: DataFrame,
    path: str,
    keys: Sequence[str],
    order: Sequence[str],
    checkpoint: str,
    deleted: str | None = None,
    keep: int = 3,
    **trigger,
) -> StreamingQuery:
    """Keep a versioned table (:class:`Snapshots`) up to date with a stream of changes, one version per batch."""

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        table = Snapshots(batch.sparkSession, path, keep)
        table.write(merge_changes(table.read(), batch, keys, order, deleted), batch_id)

    writer = changes.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
