"""Token counts as rollups kept up to date by signed deltas."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import WORD_RUN, column

SCHEMA = "source string, lang string, tokenizer_version string, docs long, tokens long"
KEYS = ["source", "lang", "tokenizer_version"]


def counts(docs: DataFrame, version: str = "word_bpe_49k-1", text: str = "text", path: str | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """source, lang, tokenizer_version, tokens and the columns in also for every row of docs; null texts have no tokens."""
    kept = ["source", "lang", *also]
    if version.startswith("words"):
        tokens = F.coalesce(F.regexp_count(column(text), F.lit(WORD_RUN)), F.lit(0)).cast("long")
        return docs.select(*map(column, kept), F.lit(version).alias("tokenizer_version"), tokens.alias("tokens"))
    rows = docs.select(F.struct(*map(column, kept)).alias("__key"), column(text).alias("__text"))
    sized = bpe.encode(rows, "__key", "__text", path)
    return sized.select("__key.*", F.lit(version).alias("tokenizer_version"), F.size("ids").cast("long").alias("tokens"))


#: Batch ids are file names.
BATCH = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]{0,99}")


class Ledger:
    """Additive totals that are kept up to date batch by batch, below one folder of a shared store.

    Each batch has three folders of its own: its signed deltas, the totals
    up to and with it (the last totals plus its deltas: a few rows a source, language and
    version, whatever the batches before held), and a mark. A batch counts once its
    mark is there. Marks are numbered: batch n writes its mark aside and claims n by renaming
    it to a name that must not exist yet, so of two writers that start from the same totals one
    wins and the other starts again from the new ones (the store must rename files
    atomically, as HDFS does), and a writer that dies leaves no half-written mark. A batch whose id has a
    mark changes nothing when it comes again; one that was lost half-way has no
    mark, isn't counted, and is written anew.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def batches(self) -> list[tuple[int, str, str]]:
        """(number, batch id, folder of totals) of each committed batch, in order."""
        marks = self._path(f"{self.root}/marks")
        if not self._fs.exists(marks):
            return []
        out = []
        for s in self._fs.listStatus(marks):
            name = s.getPath().getName()
            if m := re.fullmatch(r"(\d{9})", name):
                with_ = self._fs.open(s.getPath())
                text = bytes(with_.readAllBytes()).decode()
                with_.close()
                out.append((int(m[1]), *text.split("\n")[:2]))
        return sorted(out)

    def commit(self, batch: str, inserted: DataFrame | None = None, deleted: DataFrame | None = None, revised: DataFrame | None = None) -> bool:
        """Add a batch; True if it is new, False if it was committed before or holds nothing.

        inserted and deleted have KEYS and tokens, a row a document; revised has
        KEYS, old_tokens and tokens. Rows are summed before the shuffle by source,
        language and version, so a source with most rows is no hot spot. Null
        sources and languages are groups of their own; null counts are 0.
        """
        if not BATCH.fullmatch(batch):
            raise ValueError(f"not a batch id: {batch!r}")
        count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
        signed = []
        if inserted is not None:
            signed.append(inserted.select(*KEYS, F.lit(1).cast("long").alias("docs"), count("tokens").alias("tokens")))
        if deleted is not None:
            signed.append(deleted.select(*KEYS, F.lit(-1).cast("long").alias("docs"), (-count("tokens")).alias("tokens")))
        if revised is not None:
            signed.append(revised.select(*KEYS, F.lit(0).cast("long").alias("docs"), (count("tokens") - count("old_tokens")).alias("tokens")))
        done = self.batches()
        if not signed or batch in {b for _, b, _ in done}:
            return False
        rows = signed[0]
        for more in signed[1:]:
            rows = rows.unionByName(more)
        delta = f"{self.root}/deltas/{batch}-{uuid.uuid4().hex}"
        _summed(rows).write.parquet(delta)
        delta = self.spark.read.schema(SCHEMA).parquet(delta)
        while True:
            last = done[-1] if done else (0, "", "")
            now = f"totals/{last[0] + 1:09d}-{uuid.uuid4().hex}"
            _summed(delta.unionByName(self._totals(last[2]))).write.parquet(f"{self.root}/{now}")
            if self._claimed(last[0] + 1, f"{batch}\n{now}\n"):
                return True
            done = self.batches()
            if batch in {b for _, b, _ in done}:
                return False

    def _claimed(self, number: int, text: str) -> bool:
        """Put mark number there with this text unless it exists: written aside, then renamed, so a mark is never half-written."""
        jvm = self.spark._jvm
        path, aside = self._path(f"{self.root}/marks/{number:09d}"), self._path(f"{self.root}/marks/_{uuid.uuid4().hex}")
        out = self._fs.create(aside, False)
        out.write(bytearray(text.encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.getFileSystem(self.spark._jsc.hadoopConfiguration()).makeQualified(path).toUri(), self.spark._jsc.hadoopConfiguration())
        kept = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(aside, path, kept)
        except Exception as e:
            self._fs.delete(aside, False)
            if self._fs.exists(path):
                return False
            raise e
        return True

    def _totals(self, folder: str) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(f"{self.root}/{folder}") if folder else self.spark.createDataFrame([], SCHEMA)

    def totals(self) -> DataFrame:
        """KEYS, docs, tokens over all committed batches, as of now; groups that have come to nothing are left out. An empty ledger has no rows."""
        done = self.batches()
        return self._totals(done[-1][2] if done else "").filter("docs <> 0 or tokens <> 0")


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
