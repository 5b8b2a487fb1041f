"""Continuous quality control: FASTQ files that arrive in a folder, cleaned as a stream.

Features, trims and the cascade keep no state. Duplicates need all reads at once; a stream drops copies within a
watermark instead, where reads have a time. Reports are cumulative.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixsieve.operators.cascade import judge
from helixsieve.params import QCParams
from helixsieve.sources.fastq import PER_FILE


def stream_fastq(spark: SparkSession, folder: str, *, files_per_batch: int = 64) -> DataFrame:
    """Single-end records of the files that arrive: id1, seq1, qual1, and ord within the file."""
    return _records(spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_per_batch).load(folder))


def _records(texts: DataFrame) -> DataFrame:
    text = F.rtrim(F.replace("value", F.lit("\r"), F.lit("")), F.lit("\n"))
    rows = texts.select(F.split(text, "\n").alias("l"), F.col("_metadata.file_path").alias("file"))
    # One number too many, for a filter of files would split their texts once more.
    n = F.floor(F.size("l") / 4).cast("int")
    rows = rows.select("file", "l", n.alias("n"), F.explode(F.sequence(F.lit(0), n)).alias("i")).where("i < n")
    at = lambda k: F.get("l", F.col("i") * 4 + k - 1)
    return rows.select("file", F.col("i").cast("long").alias("ord"), at(1).alias("id1"), at(2).alias("seq1"), at(4).alias("qual1"))


def drop_copies(stream: DataFrame, p: QCParams, time_col: str, delay: str) -> DataFrame:
    """Drop later copies of a sequence within the watermark."""
    return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark([f"seq{m}" for m in p.mates()])


def _shown(judged: DataFrame, p: QCParams) -> DataFrame:
    """What a batch's outputs need of its reads: reason, bases, and of clean ones the lines."""
    bases = sum((F.length(f"seq{m}") for m in p.mates()), F.lit(0))
    own = [F.concat_ws("\t", F.lit(">+"), f"id{m}", F.lit(str(m)), f"tseq{m}", f"tqual{m}") for m in p.mates()]
    return judged.select("reason", bases.alias("bases"), F.when(F.col("reason").isNull(), F.array(*own)).alias("lines"))


def _lines(shown: DataFrame) -> DataFrame:
    return shown.where("reason is null").select(F.explode("lines").alias("value"))


def _counts(shown: DataFrame) -> DataFrame:
    return shown.groupBy(F.coalesce("reason", F.lit("clean")).alias("reason")).agg(F.count("*").alias("reads"), F.sum("bases").alias("bases"))


def lines_of(judged: DataFrame, p: QCParams) -> DataFrame:
    """Clean reads as lines of ``>+``, id, mate, bases and qualities, between tabs."""
    return _lines(_shown(judged, p))


def batch_counts(judged: DataFrame, p: QCParams) -> DataFrame:
    """Reads and bases by reason: sums that later batches add to."""
    return _counts(_shown(judged, p))


def running_counts(stream: DataFrame, p: QCParams) -> DataFrame:
    """The same as a stateful aggregate, for a query in complete or update mode; one row of state a reason."""
    return batch_counts(judge(stream, p), p)


def start(stream: DataFrame, p: QCParams, out: str, checkpoint: str, on_counts: Callable[[DataFrame, int], None] | None = None):
    """Write each batch's clean lines and counts below out, and hand on the counts so far. Batches can be repeated."""

    def each(batch: DataFrame, number: int) -> None:
        if p.rmdup and "file" in batch.columns:
            # Copies are told by ord, which is a read's place in its file.
            names = sorted(r["file"] for r in batch.select("file").distinct().collect())  # the files of a batch
            place = F.array_position(F.array(*map(F.lit, names)), F.col("file")) - 1
            batch = batch.withColumn("ord", F.col("ord") + place * PER_FILE) if names else batch
        shown = _shown(judge(batch, p), p).persist()
        _lines(shown).write.mode("overwrite").text(f"{out}/reads/batch={number}")
        _counts(shown).write.mode("overwrite").parquet(f"{out}/counts/batch={number}")
        shown.unpersist()
        if on_counts:
            so_far = batch.sparkSession.read.parquet(f"{out}/counts")
            on_counts(so_far.groupBy("reason").agg(F.sum("reads").alias("reads"), F.sum("bases").alias("bases")), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
