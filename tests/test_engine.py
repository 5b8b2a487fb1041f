"""Features, trims, cascade, reports, sources and sinks on small hand-made reads."""

import gzip
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from helixsieve import queries as Q
from helixsieve.functions import features as X
from helixsieve.operators import alignments, barcodes, cascade, reports, selection, trims
from helixsieve.params import QCParams
from helixsieve.plans.modules import filter_barcoded, filter_reads
from helixsieve.sources import alignments as S
from helixsieve.sources import fastq
from helixsieve.streaming import live

READS = "ord long, id1 string, seq1 string, qual1 string"


def single(spark, *rows):
    return spark.createDataFrame([(i, f"@r{i}", s, q or "I" * len(s)) for i, (s, q) in enumerate(rows)], READS)


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_features(spark):
    lit = F.lit
    assert value(spark, X.longest_run(lit("AANNNNC"))) == 4 and value(spark, X.longest_run(lit(""))) == 1
    assert value(spark, X.has_run(lit("ACCC"), 3)) and not value(spark, X.has_run(lit("ACcC"), 3))
    assert value(spark, X.count_base(lit("aAcN"), "A")) == 2
    assert value(spark, X.sum_quality(lit("!I#"), 33)) == 42
    assert value(spark, X.count_up_to(lit("!I&'"), 5, 33)) == 2
    assert value(spark, X.tile(lit("@A:1:1101:5:5#X/1"))) == "1101"
    assert value(spark, X.tile(lit("@M:7:F:4:2203:9:8 1:N:0:A"), 1)) == "2203"
    assert value(spark, X.fov(lit("@L1C001R002_5"))) == "C001R002" and value(spark, X.fov(lit("@L1C001R002"))) == ""
    assert value(spark, X.reverse_complement(lit("aCGTN"))) == "NACGT"
    assert value(spark, X.tail_g(lit("ACGgG"))) == 3
    assert value(spark, X.rebase_quality(lit("!I~"), 33, 64))[:2] == "@h"
    assert value(spark, X.in_spec(lit("1103"), "1101-1104")) and not value(spark, X.in_spec(lit("1105"), "1101-1104,1107"))
    assert value(spark, X.in_spec(lit("C001R002"), "C001R002")) and not value(spark, X.in_spec(lit(""), "1101"))
    assert value(spark, X.ratio(lit(0), lit(0))) is None


def test_trims_take_the_largest_cut(spark):
    p = QCParams(paired=False, hard_trim=(2, 1), trim_bad_head=(15, 4), trim_bad_tail=(15, 4), poly_g=3)
    df = trims.with_trim(single(spark, ("ACGTACGTGGGG", "!!!!!IIIIIII"), ("ACGT", "IIII"), ("ACG", "III"), ("GGGG", None), ("", "")), p)
    got = [(r["tseq1"], r["tqual1"]) for r in df.orderBy("ord").collect()]
    assert got == [("ACGT", "!III"), ("G", "I"), ("", ""), ("", ""), ("", "")]
    kinds = {(r["kind"], r["pos"]): r["n"] for r in reports.trim_positions(cascade.with_reason(df, QCParams(paired=False, min_length=None)), p).where("stage = 'raw'").collect()}
    assert kinds[("hlq", 4)] == 1 and kinds[("tg", 9)] == 1 and kinds[("tt", 4)] == 1


def test_length_sees_the_trimmed_read_and_features_the_raw_one(spark):
    p = QCParams(paired=False, hard_trim=(0, 10), min_length=25, max_n=0.2)
    got = [r["reason"] for r in cascade.judge(single(spark, ("A" * 30, None), ("A" * 36, None), ("A" * 26 + "N" * 10, None)), p).orderBy("ord").collect()]
    assert got == ["short", None, "n_ratio"]


def test_first_failure_and_mates(spark):
    rows = [(0, "a", "A" * 40, "I" * 40, "a", "C" * 40, "I" * 40), (1, "b", "A" * 10, "I" * 10, "b", "N" * 40, "!" * 40), (2, "c", "A" * 40, "!" * 40, "c", "C" * 40, "!" * 40), (3, "d", "A" * 40, "I" * 40, "d", "C" * 40, "I" * 40)]
    df = spark.createDataFrame(rows, "ord long, id1 string, seq1 string, qual1 string, id2 string, seq2 string, qual2 string")
    got = [(r["reason"], r["code"]) for r in cascade.judge(df, QCParams(rmdup=True)).orderBy("ord").collect()]
    assert got == [(None, 0), ("short", 1), ("duplicate", 3), ("duplicate", 3)]
    got = [(r["reason"], r["code"]) for r in cascade.judge(df, QCParams()).orderBy("ord").collect()]
    assert got == [(None, 0), ("short", 1), ("low_quality", 3), (None, 0)]


def test_adapters_last_or_trimmed(spark):
    a = "AGATCGGAAGAGCACACGTC"
    df = single(spark, ("ACGTACCT" * 5 + a, None), ("N" * 40 + a, None), ("ACGTACCT" * 5, None), ("ACGTAC" + a, None))
    got = [(r["reason"], r["ada1"]) for r in cascade.judge(df, QCParams(paired=False, adapters1=(a,), min_length=20)).orderBy("ord").collect()]
    assert got == [("adapter", 40), ("n_ratio", -1), (None, -1), ("adapter", 6)]
    got = [(r["reason"], r["tseq1"]) for r in cascade.judge(df, QCParams(paired=False, adapters1=(a,), adapter_mode="trim", min_length=20)).orderBy("ord").collect()]
    assert got == [(None, "ACGTACCT" * 5), ("n_ratio", "N" * 40), (None, "ACGTACCT" * 5), ("short", "ACGTAC")]


def random_reads(spark, n=200):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        s = "".join(rng.choice("ACGTN" if rng.random() < 0.1 else "ACGT") for _ in range(rng.randint(1, 60)))
        rows.append((i, f"@r{i}", s, "".join(chr(33 + rng.randint(2, 40)) for _ in s)))
    return spark.createDataFrame(rows, READS), rows


def test_reports_add_up(spark):
    df, rows = random_reads(spark)
    p = QCParams(paired=False, hard_trim=(1, 1), max_low_quality=0.3)
    run = filter_reads(df, p)
    judged = run.judged.cache()
    lost = {r["reason"]: r for r in reports.filter_report(judged).collect()}
    assert run.clean.count() + lost["total"]["total"] == len(rows)
    assert sum(r["total"] for k, r in lost.items() if k != "total") == lost["total"]["total"]
    out = run.reports()
    general = {r["stage"]: r for r in out["general"].collect()}
    assert general["raw"]["bases"] == sum(len(s) for _, _, s, _ in rows) and general["raw"]["reads"] == len(rows)
    base = out["base"].where("stage = 'raw'").collect()
    assert sum(r["total"] for r in base) == general["raw"]["bases"] == sum(r[b] for r in base for b in "acgtn")
    for r in out["quality"].where("stage = 'raw'").collect():
        own = sorted(ord(q[r["pos"] - 1]) - 33 for _, _, _, q in rows if len(q) >= r["pos"])
        assert (r["total"], r["mean"], r["p10"], r["lower"], r["median"], r["upper"], r["p90"]) == (len(own), sum(own) // len(own), own[len(own) // 10], own[len(own) // 4], own[len(own) // 2], own[3 * len(own) // 4], own[9 * len(own) // 10])
    assert all(r["max_length"] <= 60 for r in general.values())


def test_selection(spark):
    df = spark.range(0, 3000, 3).withColumnRenamed("id", "ord").repartition(7)
    ranked = selection.with_rank(df).collect()
    assert sorted((r["ord"], r["rank"]) for r in ranked) == [(3 * i, i) for i in range(1000)]
    assert [r["ord"] for r in selection.head(df, 4).collect()] == [0, 3, 6, 9]
    selection.TOP = 3
    assert sorted(r["ord"] for r in selection.head(df, 4).collect()) == [0, 3, 6, 9]
    assert sorted(r["ord"] for r in selection.sample(df, 300).collect()) == [9 * i for i in range(300)]
    assert selection.sample(df, 0.25).count() == 250 and selection.sample(df, 950).count() == 1000 and selection.sample(df, 5000).count() == 1000
    assert sorted(r["count"] for r in selection.split(df, 300).groupBy("split").count().collect()) == [100, 300, 300, 300]
    assert selection.with_rank(df.limit(0)).count() == 0
    files = df.select((F.col("ord") % 2 * (1 << 40) + F.col("ord") * 1000).alias("ord"))
    ranked = selection.with_rank(files).orderBy("ord").collect()
    assert [r["rank"] for r in ranked] == list(range(1000))


def test_fastq(spark, tmp_path):
    one, two = tmp_path / "a.fq", tmp_path / "b.fq.gz"
    one.write_bytes(b"".join(f"@r{i}/1\r\nACGT{'A' * (i % 5)}\r\n+\r\nIIII{'I' * (i % 5)}\r\n".encode() for i in range(500)))
    with gzip.open(two, "wb") as f:
        f.write(b"".join(f"@r{i}/2\nACGT\n+\n@III\n".encode() for i in range(500)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 3000)  # records lie across splits
    pairs = fastq.read_pairs(spark, str(one), str(two)).orderBy("ord").collect()
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [(r["ord"], r["id1"], r["seq1"], r["id2"], r["qual2"]) for r in pairs] == [(i, f"@r{i}/1", "ACGT" + "A" * (i % 5), f"@r{i}/2", "@III") for i in range(500)]
    both = fastq.read_fastq(spark, [str(one), str(one)])
    assert both.count() == 1000 and both.agg(F.max("ord")).first()[0] == fastq.PER_FILE + 499
    (tmp_path / "l1").write_text(f"{one}\n")
    (tmp_path / "l2").write_text(f"{two}\n")
    assert fastq.read_file_lists(spark, str(tmp_path / "l1"), str(tmp_path / "l2")).count() == 500
    out = str(tmp_path / "out")
    reads = fastq.read_fastq(spark, str(one))
    fastq.write_reads(reads, QCParams(paired=False), [out], one_file=True)
    text = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text == one.read_bytes().replace(b"\r", b"")
    fastq.write_reads(reads, QCParams(paired=False, fasta=True), [out + ".fa"])
    assert fastq.malformed(reads).count() == 0 and fastq.odd_ids(fastq.read_pairs(spark, str(one), str(two))).count() == 0
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    fastq.write_reads(reads, QCParams(paired=False), [out + ".parts"])  # several files in one folder
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(list((tmp_path / "out.parts").glob("part-*"))) > 1
    assert fastq.read_fastq(spark, out + ".parts").drop("ord").exceptAll(reads.drop("ord")).count() == 0
    assert fastq.read_fastq(spark, out + ".parts").select("ord").distinct().count() == reads.count()
    fastq.write_split(selection.split(reads, 200), QCParams(paired=False), out + ".split")
    assert sorted(p.name for p in (tmp_path / "out.split").glob("split=*")) == ["split=0", "split=1", "split=2"]
    two_short = tmp_path / "c.fq"
    two_short.write_text("@r\nA\n+\nI\n")
    with pytest.raises(Exception, match="differ in length"):
        fastq.read_pairs(spark, str(one), str(two_short)).collect()
    assert fastq.read_pairs(spark, str(one), str(two_short), check=False).count() == 1


def test_barcodes(spark, tmp_path):
    (tmp_path / "b").write_text("AAAAA 1\nCCCCC\t2\n")
    own = fastq.read_barcodes(spark, str(tmp_path / "b"))
    p = QCParams(module="filterStLFR", barcode_regions=((5, 5), (10, 5), (15, 5)), min_length=1, rmdup=True)
    rows = [(0, "@a/1", "ACGT", "IIII", "@a/2", "GGGGAAAAACCCCCAAAAT", "I" * 19), (1, "@b/1", "ACGA", "IIII", "@b/2", "GGGGAAAAACCCCCAANNA", "I" * 19), (2, "@c/1", "ACGT", "IIII", "@c/2", "GGGGAAAAACCCCCAAAAT", "I" * 19), (3, "@d/1", "ACGC", "IIII", "@d/2", "GGGGA", "I" * 5)]
    df = spark.createDataFrame(rows, "ord long, id1 string, seq1 string, qual1 string, id2 string, seq2 string, qual2 string")
    got = barcodes.with_barcodes(df, own, p).orderBy("ord").collect()
    assert [(r["barcode"], r["id1"], r["seq2"], r["too_short"]) for r in got] == [("1_2_1", "@a#1_2_1/1", "GGGG", False), ("0_0_0", "@b#0_0_0/1", "GGGG", False), ("1_2_1", "@c#1_2_1/1", "GGGG", False), ("0_0_0", "@d#0_0_0/1", "GGGGA", True)]
    assert barcodes.with_barcodes(df, own, QCParams(module="filterStLFR", barcode_regions=p.barcode_regions, ten_x=True)).where("ord = 0").first()["id2"] == "@a_1\tBX:Z:1_2_1"
    run, stats = filter_barcoded(df, own, p)
    assert stats.first().asDict() == {"pairs": 3, "pairs_with_barcode": 1, "distinct_barcodes": 1, "possible_barcodes": 8}
    assert {r["ord"]: r["reason"] for r in run.judged.collect()}[2] == "duplicate"
    assert barcodes.bad_ids(df).count() == 0


def bam(records):
    """A BAM file of (qname, flag, seq, qual)."""
    out = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 1000)
    for qname, flag, seq, qual in records:
        packed = bytes(S.BASES.index(a) << 4 | S.BASES.index(b) for a, b in zip(seq[::2], seq[1::2] + "=" * (len(seq) % 2)))
        body = struct.pack("<iiBBHHHiiii", 0, 9, len(qname) + 1, 60, 0, 1, flag, len(seq), -1, -1, 0) + qname.encode() + b"\0" + struct.pack("<I", len(seq) << 4) + packed + bytes(ord(q) - 33 for q in qual) + b"NMC\2" + b"RGZgrp\0"
        out += struct.pack("<i", len(body)) + body
    blocks = [out[i : i + 50] for i in range(0, len(out), 50)] + [b""]
    return b"".join(map(S._block, blocks))


def test_alignments(spark, tmp_path):
    good, bad = "ACGTA" * 8, "N" * 39 + "A"
    rows = [("p", 65, good, "I" * 40), ("p", 129 | 16, X_rc(good), "I" * 39 + "!"), ("q", 65, good, "I" * 40), ("q", 129, bad, "I" * 40), ("q", 65 | 256, good, "I" * 40), ("lone", 65, good, "I" * 40)]
    (tmp_path / "x.bam").write_bytes(bam(rows))
    records = S.read_bam(spark, str(tmp_path / "x.bam"))
    first = records.orderBy("ord").first()
    assert (first["qname"], first["rname"], first["pos"], first["cigar"], first["seq"], first["qual"], first["tags"]) == ("p", "chr1", 10, "40M", good, "I" * 40, "NM:i:2\tRG:Z:grp")
    S.write_sam(records, str(tmp_path / "sam"))
    again = S.read_sam(spark, str(tmp_path / "sam"))
    assert again.drop("ord").exceptAll(records.drop("ord")).count() == 0 and again.count() == 6
    header = ["@HD\tVN:1.6", "@SQ\tSN:chr1\tLN:1000"]
    S.write_bam(records, str(tmp_path / "bam"), header=header, one_file=True)
    back = S.read_bam(spark, str(tmp_path / "bam"))
    assert back.exceptAll(records).count() == 0 and back.count() == 6
    assert S.read_bam_header(spark, str(tmp_path / "bam")) == header
    S.write_sam(records, str(tmp_path / "sam2"), header=header, one_file=True)
    assert S.read_header(spark, str(tmp_path / "sam2")) == header and S.read_sam(spark, str(tmp_path / "sam2")).count() == 6
    marked, rejected = alignments.mark(records, QCParams())
    assert {(r["qname"], r["flag"]) for r in marked.collect()} == {("p", 65), ("p", 145), ("q", 65 | 512), ("q", 129 | 512), ("q", 321 | 512), ("lone", 65)}
    assert [r["qname"] for r in rejected.collect()] == ["lone"]
    assert alignments.grouped(records, True).where("id1 = 'p'").first()["seq2"] == good
    assert alignments.grouped(records, False).count() == 3


def X_rc(seq):
    return seq.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def test_phred_check(spark):
    df, _ = random_reads(spark)
    assert reports.phred_check(df, QCParams(paired=False)) > 0
    with pytest.raises(ValueError):
        reports.phred_check(df, QCParams(paired=False, phred_in=64))


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(3):
        (folder / f"{k}.fq").write_text("".join(f"@r{i}\n{'A' * (20 + 20 * (i % 2))}\n+\n{'I' * (20 + 20 * (i % 2))}\n" for i in range(10)))
    p, seen = QCParams(paired=False), []
    stream = live.stream_fastq(spark, str(folder), files_per_batch=1)
    live.start(stream, p, str(tmp_path / "out"), str(tmp_path / "state"), lambda counts, n: seen.append({r["reason"]: r["reads"] for r in counts.collect()})).awaitTermination()
    assert seen[-1] == {"clean": 15, "short": 15} and len(seen) == 3
    assert spark.read.text(str(tmp_path / "out/reads")).count() == 15
    q = live.running_counts(stream, p).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["reason"]: r["reads"] for r in spark.table("counts").collect()} == {"clean": 15, "short": 15}


def test_small_rna_takes_every_read(spark):
    from helixsieve import queries
    from helixsieve.fixtures import reads

    sf = "/root/testdata/sf0.001"
    n = reads(spark, sf).count()
    assert queries.srna_adapters(spark, sf).count() == queries.filter_srna(spark, sf).count() == n


def test_likely_duplicates_has_no_idle_parameter():
    import inspect

    from helixsieve.operators import selection

    assert list(inspect.signature(selection.likely_duplicates).parameters) == ["df", "seqs"]


def test_fastq_by_line_numbers(spark, tmp_path):
    """Records are four lines by number, whatever the lines look like and wherever blocks are cut."""
    import random

    rng = random.Random(5)
    odd = ["@", "+", "@x", "+y", "", "ACGT", "@r +", "IIII"]

    def lines(kind):
        if kind == "good":
            return [x for i in range(300) for x in (f"@r{i}", "ACGT" * rng.randint(1, 9), rng.choice(["+", f"+r{i}"]), rng.choice("@+I") + "I" * rng.randint(3, 30))]
        if kind == "bad":  # records without @, or without + in the third line
            return [x for i in range(300) for x in (rng.choice(["r", "@r"]) + str(i), "ACGT", rng.choice(["+", "-"]), "@III")]
        if kind == "shifted":  # a line too many in the middle: later lines look like records at other places
            own = lines("good")
            return own[:600] + ["extra"] + own[600:]
        return [rng.choice(odd) for _ in range(801)] + ["end"]

    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for kind in ("good", "bad", "shifted", "noise"):
        path, own = tmp_path / kind, lines(kind)
        path.write_text("\n".join(own) + "\n\n")
        want = [(k // 4, own[k], own[k + 1], own[k + 3]) for k in range(0, len(own) - 3, 4)]
        for size, most in ((61, 100_000), (700, 0), (1 << 20, 100_000)):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            fastq.MOST_BLOCKS, held = most, fastq.MOST_BLOCKS
            try:
                got = [(r["ord"], r["id1"], r["seq1"], r["qual1"]) for r in fastq.read_fastq(spark, str(path)).orderBy("ord").collect()]
            finally:
                fastq.MOST_BLOCKS = held
                spark.conf.set("spark.sql.files.maxPartitionBytes", old)
            assert [r for r in got if 4 * r[0] + 3 < len(own)] == want, (kind, size)
    (tmp_path / "none").write_text("")
    assert fastq.read_fastq(spark, str(tmp_path / "none")).count() == 0


def test_round_trip_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr("helixsieve.fixtures.LEAST", 100)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = Q.fastq_round_trip(spark, "/root/testdata/sf0.001")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got.inputFiles()) > 1 and got.count() == 1500


def test_equal_barcodes_expand_once(spark):
    own = spark.createDataFrame([("ACGT", i, i) for i in range(500)] + [("TTTT", 600, 600), ("ANGT", 700, 700)], "barcode string, barcode_id int, ord long")
    known = barcodes.expand(own)
    assert "SortAggregate" not in known._jdf.queryExecution().executedPlan().toString()
    got = {r["segment"]: r["barcode_id"] for r in known.collect()}
    assert got["ACGA"] == 499 and got["TTTA"] == 600 and got["ACGT"] == got["AAGT"] == got["ANGA"] == 700
    assert len(got) <= barcodes.most_segments(own) == 2 * 16 + 16


def test_long_barcode_lists_leave_reads_where_they_are(spark):
    own = spark.range(60_000).select(F.translate(F.lpad(F.conv(F.col("id").cast("string"), 10, 4), 10, "0"), "0123", "ACGT").alias("barcode"), F.col("id").cast("int").alias("barcode_id"), F.col("id").alias("ord"))
    df = Q.reads(spark, "/root/testdata/sf0.001")
    plan = barcodes.with_barcodes(df, own, QCParams(module="filterStLFR"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan


@pytest.mark.parametrize("rows", (1, 3, 10_000))
def test_copies_by_digest(spark, rows):
    n = 400
    df = spark.range(n).select((F.col("id") * 37 % 1009 * 50).alias("ord"), F.when(F.col("id") % 4 == 0, "").when(F.col("id") % 50 == 1, None).otherwise((F.col("id") % 90).cast("string")).alias("seq1"), F.lit("A").alias("seq2"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        met = selection.with_copies(df, "dup", "seq1", "seq2")
        assert "SortMergeJoin" not in met._jdf.queryExecution().executedPlan().toString()
        got = met.select("ord", "seq1", "dup").collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    first = {}
    for r in got:
        first[r["seq1"]] = min(first.get(r["seq1"], r["ord"]), r["ord"])
    assert len(got) == n and all(r["dup"] == (r["seq1"] is not None and r["ord"] > first[r["seq1"]]) for r in got)


def test_copies_derive_reads_after_they_are_spread(spark):
    df = Q.reads(spark, "/root/testdata/sf0.001")
    plan = selection.copies(df, "seq1", "seq2")._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("RepartitionByExpression")
    assert "md5(" in above and "md5(" not in below


def test_stream_copies_of_files(spark, tmp_path):
    for i in range(2):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.fq").write_text("@r\nACGT\n+\nFFFF\n")
    p = QCParams(paired=False, min_length=None, rmdup=True, max_low_quality=None)
    live.start(live.stream_fastq(spark, str(tmp_path / "in")), p, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted((r["reason"], r["reads"]) for r in spark.read.parquet(str(tmp_path / "out" / "counts")).collect()) == [("clean", 1), ("duplicate", 1)]


def test_stream_splits_texts_once(spark, tmp_path):
    plan = live._records(spark.read.option("wholetext", True).text(str(tmp_path)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
