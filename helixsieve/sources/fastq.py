"""FASTQ and FASTA files, barcode lists and configurations.

Files are read by Spark's text source, so plain files are split, gzip files are one task each, and any file system
that Spark knows will do. A line's number follows from its block's place and its place in the block; ``ord`` is the
file's place in the list and the record's in the file.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from helixsieve.functions import features as X
from helixsieve.params import QCParams

#: Records of one file at most.
PER_FILE = 1 << 40
#: Lines of a block that say where its records begin.
FIRST_LINES = 64
#: Rows of a table of blocks that is broadcast: some MB.
MOST_BLOCKS = 100_000


def numbered_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """file (place in paths), line (from 0 in its file) and value."""
    out = None
    for i, path in enumerate(paths):
        lines = spark.read.text(path).select(F.lit(i).alias("file"), "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
        blocks = lines.groupBy("path", "block").agg(F.count("*").alias("n"), F.min("id").alias("first"))
        # One row a block, and one a part file of a folder: counts run within files, and over them.
        inside, over = W.partitionBy("path").orderBy("block"), W.orderBy("path")
        parts = blocks.groupBy("path").agg(F.sum("n").alias("all")).select("path", (F.sum("all").over(over) - F.col("all")).alias("files"))
        blocks = blocks.withColumn("here", F.sum("n").over(inside) - F.col("n")).join(parts, "path").select("path", "block", "first", (F.col("files") + F.col("here")).alias("before"))
        lines = lines.join(blocks, ["path", "block"]).select("file", (F.col("before") + F.col("id") - F.col("first")).alias("line"), F.regexp_replace("value", "\r$", "").alias("value"))
        out = lines if out is None else out.unionByName(lines)
    return out


def _before(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Lines (value, path as a hash, block) and blocks (path, block, before: the lines ahead of the block)."""
    text = spark.read.text(path)
    lines = text.select("value", F.xxhash64("_metadata.file_path").alias("path"), F.col("_metadata.file_path").alias("name"), F.col("_metadata.file_block_start").alias("block"))
    blocks = lines.groupBy("name", "path", "block").agg(F.count("*").alias("n"))
    # One row a block, and one a part file of a folder: counts run within files, and over them.
    inside, over = W.partitionBy("name").orderBy("block"), W.orderBy("name")
    parts = blocks.groupBy("name").agg(F.sum("n").alias("all")).select("name", (F.sum("all").over(over) - F.col("all")).alias("files"))
    blocks = blocks.withColumn("here", F.sum("n").over(inside) - F.col("n")).join(parts, "name")
    blocks = blocks.select("path", "block", (F.col("files") + F.col("here")).alias("before"))
    # As many blocks at most as files, and splits of the bytes; of few, the table is a few MB.
    size, split = text._jdf.queryExecution().optimizedPlan().stats().sizeInBytes(), spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    few = len(text.inputFiles()) + spark.sparkContext.defaultParallelism + 2 * int(str(size)) // split <= MOST_BLOCKS
    return lines.drop("name"), F.broadcast(blocks) if few else blocks


def _phase(lines: pa.Array, first: bool) -> int | None:
    """The place of a record's first line among a block's lines: where most often @ is two lines ahead of +.

    A quality may begin with @ or +, but then a sequence is two lines on or back. None if the lines don't say.
    """
    at, plus = (pc.starts_with(lines, c).to_numpy(zero_copy_only=False) for c in "@+")
    votes = np.bincount(np.flatnonzero(at[:-2] & plus[2:]) % 4, minlength=4)
    best = int(votes.argmax())
    if (votes == votes[best]).sum() == 1:
        return best
    return 0 if first else None


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of a block's lines (whole), and the lines of records that a block begins or ends in.

    ``at`` is the first line's place in the block. A plain third line is null. The place where records begin is a guess
    by the block's first lines; who knows the lines ahead of the block must check it.
    """
    key, held, at, phase = None, [], 0, None
    names = ["path", "block", "at", "whole", "id", "seq", "plus", "qual"]

    def rows(whole: bool, first: np.ndarray, *columns: pa.Array | None) -> pa.RecordBatch:
        n = len(first)
        texts = [pa.nulls(n, pa.string()) if c is None else c.cast(pa.string()) for c in columns]
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, key[0])), pa.array(np.full(n, key[1])), pa.array(first.astype(np.int64)), pa.array(np.full(n, whole)), *texts], names)

    def emit(end: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, at, phase
        lines = pa.concat_arrays(held)
        if pc.any(pc.ends_with(lines, "\r")).as_py():
            lines = pc.replace_substring_regex(lines, "\r$", "")
        if phase is None:
            phase = _phase(lines, key[1] == 0)
            start = len(lines) if phase is None else min(phase, len(lines))
            if start:
                yield rows(False, at + np.arange(start), lines[:start], None, None, None)
            lines, at = lines[start:], at + start
        n = len(lines) // 4
        if n:
            first = 4 * np.arange(n)
            one, two, three, four = (lines.take(pa.array(first + j)) for j in range(4))
            three = pc.if_else(pc.equal(three, "+"), pa.scalar(None, three.type), three)
            yield rows(True, at + first, one, two, three, four)
            lines, at = lines[4 * n :], at + 4 * n
        if end and len(lines):
            yield rows(False, at + np.arange(len(lines)), lines, None, None, None)
        held = [] if end else [lines]

    for batch in batches:
        if not batch.num_rows:
            continue
        path, block = (batch.column(c).to_numpy() for c in ("path", "block"))
        cuts = [0, *(np.flatnonzero((path[1:] != path[:-1]) | (block[1:] != block[:-1])) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if (path[a], block[a]) != key:
                if held:
                    yield from emit(True)
                key, held, at, phase = (path[a], block[a]), [], 0, None
            held.append(batch.column("value").slice(a, b - a))
            if sum(map(len, held)) >= FIRST_LINES:
                yield from emit(False)
    if held:
        yield from emit(True)


def _pieces(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """ord, id, seq and qual of records, or of lines of records that lie across blocks or weren't recognised."""
    out = None
    for i, path in enumerate([paths] if isinstance(paths, str) else paths):
        lines, blocks = _before(spark, path)
        rows = lines.mapInArrow(_assemble, "path long, block long, at long, whole boolean, id string, seq string, plus string, qual string").join(blocks, ["path", "block"])
        line = F.col("before") + F.col("at")

        def record(n: Column, i: int = i, **own: Column) -> Column:
            ord_ = F.lit(i * PER_FILE) + F.shiftright(n, 2)
            return F.struct(ord_.alias("ord"), *(own.get(c, F.lit(None).cast("string")).alias(c) for c in ("id", "seq", "qual")))

        def single(n: Column, value: Column, record=record) -> Column:
            pick = lambda j: F.when(n % 4 == j, value)
            return record(n, id=pick(0), seq=pick(1), qual=pick(3))

        four = [F.col("id"), F.col("seq"), F.coalesce("plus", F.lit("+")), F.col("qual")]
        own = F.when(~F.col("whole"), F.array(single(line, F.col("id")))).when(line % 4 == 0, F.array(record(line, id=four[0], seq=four[1], qual=four[3])))
        rows = rows.select(F.explode(own.otherwise(F.array(*(single(line + j, c) for j, c in enumerate(four))))).alias("x")).select("x.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def _gathered(pieces: DataFrame, mates: Sequence[int]) -> DataFrame:
    """A row a record. Pieces move once, and are sorted by ord once, by their tasks."""
    return pieces.repartition("ord").groupBy("ord").agg(*(F.max(f"{c}{m}").alias(f"{c}{m}") for m in mates for c in ("id", "seq", "qual")))


def _there(mate: int) -> Column:
    """Whether a record is more than empty lines at a file's end."""
    return F.coalesce(F.col(f"id{mate}") != "", F.lit(False)) | F.col(f"seq{mate}").isNotNull()


def _named(pieces: DataFrame, mate: int) -> DataFrame:
    return pieces.select("ord", *(F.col(c).alias(f"{c}{mate}") for c in ("id", "seq", "qual")))


def read_fastq(spark: SparkSession, paths: str | Sequence[str], mate: int = 1) -> DataFrame:
    """ord, id1, seq1, qual1 (or of mate 2) of each record; the third line is dropped.

    Tasks put records together where they read them. Lines of records that lie across blocks, and of blocks whose records
    begin elsewhere than their first lines suggest, meet by their numbers.
    """
    return _gathered(_named(_pieces(spark, paths), mate), [mate]).where(_there(mate))


def read_pairs(spark: SparkSession, paths1: str | Sequence[str], paths2: str | Sequence[str], *, check: bool = True) -> DataFrame:
    """Mates by place, brought together by the one exchange that completes records.

    With check a record without its mate fails the run when it is met; without, it is left out.
    """
    one, two = _named(_pieces(spark, paths1), 1), _named(_pieces(spark, paths2), 2)
    pairs = _gathered(one.unionByName(two, allowMissingColumns=True), (1, 2))
    if not check:
        return pairs.where(_there(1) & _there(2))
    message = F.concat(F.lit("the files differ in length: record "), F.col("ord").cast("string"), F.lit(" has no mate"))
    return pairs.where(_there(1) | _there(2)).withColumn("id1", F.when(_there(1) & _there(2), F.col("id1")).otherwise(F.raise_error(message).cast("string")))


def read_file_lists(spark: SparkSession, list1: str, list2: str) -> DataFrame:
    """Pairs from two files that list paths, one a line; the files are read one after another."""
    paths = [[r["value"].strip() for r in spark.read.text(x).collect() if r["value"].strip()] for x in (list1, list2)]
    return read_pairs(spark, *paths)


def odd_ids(pairs: DataFrame) -> DataFrame:
    """Pairs whose ids differ in more than one character."""
    differ = F.size(F.filter(F.arrays_zip(F.split("id1", "").alias("a"), F.split("id2", "").alias("b")), lambda x: ~x["a"].eqNullSafe(x["b"])))
    return pairs.where(differ > 1)


def malformed(reads: DataFrame, mate: int = 1) -> DataFrame:
    """Records without @, with other letters than ACGTN, or whose lengths differ."""
    seq, qual = F.col(f"seq{mate}"), F.col(f"qual{mate}")
    return reads.where(~(F.startswith(f"id{mate}", F.lit("@")) & X.valid(seq) & (F.length(seq) == F.coalesce(F.length(qual), F.lit(-1)))))


def read_barcodes(spark: SparkSession, path: str) -> DataFrame:
    """barcode, barcode_id and ord from a list of two columns between white space."""
    cols = F.split(F.trim("value"), r"\s+")
    lines = numbered_lines(spark, [path]).where(F.trim("value") != "")
    return lines.select(cols[0].alias("barcode"), cols[1].cast("int").alias("barcode_id"), F.col("line").alias("ord"))


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text, such as a configuration or a list of adapters."""
    return "\n".join(r["value"] for r in numbered_lines(spark, [path]).orderBy("line").collect())


def finished(df: DataFrame, p: QCParams, *, trimmed: bool = True) -> DataFrame:
    """Reads as they are written: trimmed, mate suffix, base converted, qualities rebased."""
    for m in p.mates():
        seq, qual = (F.col(f"tseq{m}"), F.col(f"tqual{m}")) if trimmed and f"tseq{m}" in df.columns else (F.col(f"seq{m}"), F.col(f"qual{m}"))
        df = df.withColumn(f"oseq{m}", X.convert_base(seq, *p.base_convert) if p.base_convert else seq)
        df = df.withColumn(f"oqual{m}", X.rebase_quality(qual, p.phred_in, p.phred_out))
        df = df.withColumn(f"oid{m}", F.concat(f"id{m}", F.lit(f"/{m}")) if p.mate_suffix else F.col(f"id{m}"))
    return df


def as_text(df: DataFrame, p: QCParams, mate: int) -> DataFrame:
    """One value a record, lines between, in order: FASTQ or FASTA."""
    own = [F.col(f"{c}{mate}") for c in ("oid", "oseq", "oqual")]
    value = F.concat_ws("\n", F.regexp_replace(own[0], "^@", ">"), own[1]) if p.fasta else F.concat_ws("\n", own[0], own[1], F.lit("+"), own[2])
    return df.orderBy("ord").select(value.alias("value"))


def write_reads(df: DataFrame, p: QCParams, paths: Sequence[str], *, one_file: bool = False) -> None:
    """Write each mate's reads to a folder, in order over its part files; gzip if the path ends in .gz."""
    df = finished(df, p)
    for mate, path in zip(p.mates(), paths, strict=True):
        out = as_text(df, p, mate)
        out = out.coalesce(1) if one_file else out
        out.write.option("compression", "gzip" if path.endswith(".gz") else "none").text(path)


def write_split(df: DataFrame, p: QCParams, path: str, mate: int = 1) -> None:
    """Write reads that have a column ``split`` into a folder for each part, in order over its files.

    Tasks take ranges of the order, so a part of any size is written by as many as it needs.
    """
    df = finished(df, p)
    own = [F.col(f"{c}{mate}") for c in ("oid", "oseq", "oqual")]
    rows = df.select("split", "ord", F.concat_ws("\n", own[0], own[1], F.lit("+"), own[2]).alias("value"))
    rows = rows.repartitionByRange("split", "ord").sortWithinPartitions("split", "ord")
    rows.select("split", "value").write.partitionBy("split").option("compression", "gzip").text(path)
