"""Documents by key in a fixed number of buckets, with snapshots that are published whole.

A snapshot is a manifest: for each bucket the folder with its documents. A commit
reads only the buckets that its batch touches, writes them anew into a folder
of its own and publishes a manifest that points to these and, for all others, to the
folders of the snapshot before. The manifest is written aside and renamed to the next
number, which fails if another writer took it; the commit then starts again from that
snapshot. A writer that dies leaves the last snapshot as it is and a folder that
nothing names, which vacuum deletes.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import safe_component

DOCUMENT = "key string, value string"


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; a temporary one only in a local session without it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="evidentia-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


@dataclass(frozen=True)
class Snapshot:
    """Version, number of buckets, folder of each bucket that has documents, and the last batch of each source."""

    version: int = 0
    buckets: int = 64
    folders: dict[str, str] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)


class Taken(RuntimeError):
    """Another writer published the version."""


class Store:
    """Documents below root. buckets counts for a new store; one that is there keeps its own number."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64) -> None:
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _path(self, *parts: str):  # noqa: ANN202  a path of the JVM
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _files(self):  # noqa: ANN202
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        fs, at = self._files(), self._path("manifests")
        if not fs.exists(at):
            return []
        return sorted(int(f.getPath().getName()[:-5]) for f in fs.listStatus(at) if f.getPath().getName().endswith(".json") and f.getPath().getName()[0].isdigit())

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The last snapshot, or that of a version; an empty one where there is none."""
        found = self.versions() if version is None else [version]
        if not found:
            return Snapshot(buckets=self.buckets)
        stream = self._files().open(self._path("manifests", f"{found[-1]:020d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Snapshot(**json.loads(text))

    def _publish(self, new: Snapshot) -> None:
        jvm, fs = self.spark._jvm, self._files()
        aside = self._path("manifests", f"_{uuid.uuid4().hex}")
        stream = fs.create(aside, False)
        stream.write(json.dumps(vars(new), sort_keys=True).encode())
        stream.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(self._path()).toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(aside, self._path("manifests", f"{new.version:020d}.json"), none)
        except Exception as e:
            fs.delete(aside, False)
            if "FileAlreadyExists" in str(e):
                raise Taken(str(new.version)) from e
            raise

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")

    def read(self, version: int | None = None) -> DataFrame:
        """key, value of a snapshot; by default the last one."""
        return self._read(self.snapshot(version), None)

    def _read(self, at: Snapshot, buckets: set[int] | None) -> DataFrame:
        folders = [f"{self.root}/{x}" for b, x in sorted(at.folders.items()) if buckets is None or int(b) in buckets]
        if not folders:
            return self.spark.createDataFrame([], DOCUMENT)
        return self.spark.read.schema(DOCUMENT).parquet(*folders)

    def get(self, keys: DataFrame) -> DataFrame:
        """key, value of those keys (column key) that are there; only their buckets are read."""
        at = self.snapshot()
        wanted = keys.select("key").distinct()
        touched = {r[0] for r in wanted.select(self._bucket(at.buckets)).distinct().collect()}
        return self._read(at, touched).join(wanted, "key", "left_semi")

    def commit(self, documents: DataFrame, source: str = "", batch: int | None = None, tries: int = 8) -> int:
        """Put documents (key, value; a null value removes the key); the version they are in.

        Of rows with one key in a batch the largest value stays, a removal before
        none; keys that aren't safe as file names are an error and nothing is kept. A batch
        with a number counts once: one that isn't higher than the last of its source changes
        nothing. A snapshot has as many folders as buckets, each written by one task.
        """
        key = F.when(safe_component(F.col("key")) & ~F.col("key").rlike("\\A[.]+\\z"), F.col("key")).otherwise(F.raise_error(F.concat(F.lit("unsafe key: "), F.coalesce(F.col("key"), F.lit("null")))))
        one = documents.select(key.alias("key"), F.col("value").cast("string").alias("value")).groupBy("key").agg(F.max("value").alias("value"))
        for _ in range(tries):
            last = self.snapshot()
            if batch is not None and batch <= last.batches.get(source, batch - 1):
                return last.version
            bucket = self._bucket(last.buckets)
            new = one.withColumn("bucket", bucket)
            touched = sorted(r[0] for r in new.select("bucket").distinct().collect())
            old = self._read(last, set(touched)).withColumn("bucket", bucket)
            merged = old.join(new.select("key"), "key", "left_anti").unionByName(new.filter("value is not null"))
            folder = f"data/{uuid.uuid4().hex}"
            spread = merged.repartition(max(1, len(touched)), "bucket").sortWithinPartitions("bucket", "key")
            spread.write.partitionBy("bucket").parquet(f"{self.root}/{folder}")
            fs = self._files()
            folders = dict(last.folders)
            for b in touched:
                folders.pop(str(b), None)
                if fs.exists(self._path(folder, f"bucket={b}")):
                    folders[str(b)] = f"{folder}/bucket={b}"
            batches = last.batches if batch is None else last.batches | {source: batch}
            try:
                self._publish(Snapshot(last.version + 1, last.buckets, folders, batches))
            except Taken:
                continue
            return last.version + 1
        raise Taken(f"no version was free in {tries} tries")

    def vacuum(self, keep: int = 2) -> int:
        """Delete folders that none of the last keep snapshots names, and older manifests; how many folders went. No commit may be under way."""
        fs = self._files()
        versions = self.versions()
        kept = {x.split("/")[1] for v in versions[-keep:] for x in self.snapshot(v).folders.values()}
        for v in versions[:-keep]:
            fs.delete(self._path("manifests", f"{v:020d}.json"), False)
        gone = 0
        if fs.exists(self._path("data")):
            for f in fs.listStatus(self._path("data")):
                if f.getPath().getName() not in kept:
                    fs.delete(f.getPath(), True)
                    gone += 1
        return gone
