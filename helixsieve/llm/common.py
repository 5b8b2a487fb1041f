"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Bytes that separate words, as a regular expression's class: space, tab to carriage return.
SPACE = r"\x20\x09-\x0D"
#: A word, and the same bytes for ``bytes.translate``.
WORD = rf"[^{SPACE}]+"
SPACE_BYTES = b" \t\n\x0b\x0c\r"
#: Spark's setting to delete an execution's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables that driver and executors all see.

    It is ``spark.checkpoint.dir`` where the cluster names one. Only a local session, whose executors live in the
    driver's process, may go without; it gets a temporary folder.
    """
    conf = spark.sparkContext.getConf()
    if at := conf.get("spark.checkpoint.dir"):
        return at.rstrip("/")
    if not (conf.get("spark.master") or "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    at = getattr(spark, "_helixsieve_dir", None) or "file://" + tempfile.mkdtemp(prefix="helixsieve-")
    spark._helixsieve_dir = at
    return at


class Scratch:
    """Intermediate tables of one run, as Parquet below :func:`shared_dir`.

    A written table cuts the lineage: a lost executor costs its running tasks, not the steps before.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.top = spark, f"{shared_dir(spark)}/helixsieve/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.top}/{name}"

    def save(self, df: DataFrame, name: str, **options) -> DataFrame:
        """Write df, and read it back with its schema. The shuffle files that it took go once it is written."""
        held = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.options(**options).parquet(self.path(name))
        finally:
            self.spark.conf.set(CLEANUP, held)
        return self.load(name, df)

    def load(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads; all of them without a name."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for at in [self.path(n) for n in names] or [self.top]:
            p = jvm.org.apache.hadoop.fs.Path(at)
            p.getFileSystem(conf).delete(p, True)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Hold Arrow batches of whole texts to a few MB; a session's own smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


#: Nodes of a plan that neither multiply nor move a file's rows.
_SCAN = {"LogicalRelation", "Project", "Filter", "SubqueryAlias", "View"}


def _is_scan(df: DataFrame) -> bool:
    """Whether df is one file scan, projected and filtered by expressions that every scan evaluates alike."""
    plan = df._jdf.queryExecution().analyzed()
    relations = 0
    while True:
        name = plan.nodeName() if "LogicalRelation" not in plan.getClass().getName() else "LogicalRelation"
        if name not in _SCAN:
            return False
        relations += name == "LogicalRelation"
        if not plan.children().size():
            return relations == 1 and df._jdf.queryExecution().analyzed().deterministic()
        plan = plan.children().head()


def settled(df: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """df if it is a plain scan of files that number their rows, and else a table it is written to."""
    if _is_scan(df):
        try:
            return df.select("*", df.metadataColumn("_metadata")["row_index"].alias("__place")).drop("__place")
        except AnalysisException:  # files of a kind that has no row numbers
            pass
    return (scratch or Scratch(df.sparkSession, "settled")).save(df, f"rows-{uuid.uuid4().hex}")


def with_uid(df: DataFrame, name: str = "uid", scratch: Scratch | None = None) -> DataFrame:
    """Add a key for each row, repeated rows included: hash of the file, and place in the file.

    It doesn't depend on how a scan is split, so that all scans of one table agree. A frame that is no plain scan of
    files with such places (a join, a shuffle, rows of the driver) is written as a table first, and the table is keyed.
    """
    df = settled(df, scratch)
    place = df.metadataColumn("_metadata")
    return df.withColumn(name, F.struct(F.xxhash64(place["file_path"]).alias("f"), place["row_index"].alias("r")))


def in_order(df: DataFrame, keys: Sequence[str], scratch: Scratch, name: str) -> DataFrame:
    """df in a global order by keys, written once, with ``rank`` (from 0) and ``part``, the range that a row is in.

    One exchange into ranges of near equal rows; equal keys are split too if the keys end in one that tells rows apart.
    A row's place in its range's file is its rank there, so nothing is counted but rows a range, and what is broadcast
    is one row a range: as many as the session has shuffle partitions.
    """
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id())
    rows = scratch.save(rows, name, maxRecordsPerFile=0)
    before = rows.groupBy("part").agg(F.count("*").alias("n")).select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("__before"))
    rows = rows.withColumn("__at", rows.metadataColumn("_metadata")["row_index"]).join(F.broadcast(before), "part")
    return rows.withColumn("rank", F.col("__before") + F.col("__at")).drop("__at", "__before")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
