"""Queries over reads derived from ``orders``, and the same in SQL for DuckDB."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixsieve.fixtures import ADAPTER1, ADAPTER2, BARCODED, BARCODES, READS, reads
from helixsieve.functions import features as X
from helixsieve.functions import matching as M
from helixsieve.operators import alignments, barcodes, cascade, reports, selection, trims
from helixsieve.params import Approx, QCParams
from helixsieve.plans.modules import filter_barcoded, filter_reads
from helixsieve.sources import fastq
from helixsieve.sources.scratch import scratch_path
from helixsieve.streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

R = f"({READS}) r"
#: Trims of the trim queries: hard, low-quality ends, poly-G.
TRIMS = {"hard_trim": (3, 5, 2, 4), "trim_bad_head": (15, 8), "trim_bad_tail": (15, 8), "poly_g": 10}


def query(sql: str | None = None):
    def add(own: Callable[[SparkSession, str], DataFrame]):
        QUERIES[own.__name__] = own
        if sql:
            ORACLES[own.__name__] = sql
        return own

    return add


# Fragments of oracle SQL.
def n_of(base: str, seq: str) -> str:
    return f"(length({seq}) - length(replace(replace({seq}, '{base}', ''), '{base.lower()}', '')))"


def codes(text: str) -> str:
    return f"list_transform(string_split({text}, ''), lambda c: ascii(c) - 33)"


def count_if(text: str, cond: str) -> str:
    return f"len(list_filter({codes(text)}, lambda q: {cond}))"


def revcomp(seq: str) -> str:
    return f"reverse(translate(upper({seq}), 'ACGT', 'TGCA'))"


def real(x: str) -> str:
    return f"CAST({x} AS REAL)"


def ratio(a: str, b: str) -> str:
    return real(f"{real(a)} / {real(b)}")


COUNTS = ", ".join(f"{n_of(b, 'seq1')} AS {b.lower()}" for b in "ACGTN")


@query(f"SELECT ord, length(seq1) AS len, {COUNTS}, {ratio(n_of('N', 'seq1'), 'length(seq1)')} AS n_ratio, {ratio(n_of('G', 'seq1') + ' + ' + n_of('C', 'seq1'), 'length(seq1)')} AS gc_ratio FROM {R}")
def read_base_stats(spark, sf_dir):
    f = F.col("f")
    df = reads(spark, sf_dir).select("ord", X.scalar_features(F.col("seq1"), F.col("qual1")).alias("f"))
    return df.select("ord", *(f[c].alias(c) for c in ("len", "a", "c", "g", "t", "n")), X.ratio(f["n"], f["len"]).alias("n_ratio"), X.ratio(f["g"] + f["c"], f["len"]).alias("gc_ratio"))


@query(f"SELECT ord, {count_if('qual1', 'q <= 5')} AS low, {count_if('qual1', 'q >= 20')} AS q20, {count_if('qual1', 'q >= 30')} AS q30, CAST(list_sum({codes('qual1')}) AS INT) AS qsum, {ratio(f'list_sum({codes("qual1")})', 'length(qual1)')} AS mean FROM {R}")
def read_quality_stats(spark, sf_dir):
    f = F.col("f")
    df = reads(spark, sf_dir).select("ord", X.scalar_features(F.col("seq1"), F.col("qual1")).alias("f"))
    return df.select("ord", *(f[c].alias(c) for c in ("low", "q20", "q30", "qsum")), X.ratio(f["qsum"], f["len"]).alias("mean"))


@query(f"SELECT ord, list_max(list_transform(regexp_extract_all(seq1, 'A+|C+|G+|T+|N+'), lambda x: length(x))) AS longest, regexp_matches(seq1, 'A{{6}}|C{{6}}|G{{6}}|T{{6}}|N{{6}}') AS six FROM {R}")
def longest_homopolymer(spark, sf_dir):
    return reads(spark, sf_dir).select("ord", X.longest_run(F.col("seq1")).alias("longest"), X.has_run(F.col("seq1"), 6).alias("six"))


@query(f"SELECT ord, {revcomp('seq1')} AS rc FROM {R}")
def revcomp_reads(spark, sf_dir):
    return reads(spark, sf_dir).select("ord", X.reverse_complement(F.col("seq1")).alias("rc"))


@query(f"SELECT ord, length(regexp_extract(seq1, '[Gg]*$')) AS tail_g FROM {R}")
def tail_g_runs(spark, sf_dir):
    return reads(spark, sf_dir).select("ord", X.tail_g(F.col("seq1")).alias("tail_g"))


FROM, TO = ("".join(chr(b + i) for i in range(63)).replace("'", "''") for b in (33, 64))


@query(f"SELECT ord, translate(qual1, '{FROM}', '{TO}') AS qual64, translate(qual1, '{FROM}', '{TO}') <> qual1 AS changed FROM {R}")
def quality_rebase(spark, sf_dir):
    q = X.rebase_quality(F.col("qual1"), 33, 64)
    return reads(spark, sf_dir).select("ord", q.alias("qual64"), (q != F.col("qual1")).alias("changed"))


@query(f"SELECT ord, replace(seq1, 'T', 'U') AS rna FROM {R}")
def base_convert(spark, sf_dir):
    return reads(spark, sf_dir).select("ord", X.convert_base(F.col("seq1"), "T", "U").alias("rna"))


@query(f"SELECT ord, regexp_replace(id1, '#[^/]*', '') AS id_a, regexp_replace('@M01:7:FC1:4:1101:9:8 1:N:0:ACGT', ':[^:]*$', '') AS id_b FROM {R}")
def index_remove(spark, sf_dir):
    return reads(spark, sf_dir).select("ord", X.remove_index(F.col("id1")).alias("id_a"), X.remove_index(F.lit("@M01:7:FC1:4:1101:9:8 1:N:0:ACGT"), 1).alias("id_b"))


FOV_ID = "'@FCD1PB1L4C' || lpad(CAST(ord % 7 + 1 AS STRING), 3, '0') || 'R' || lpad(CAST(ord % 5 + 1 AS STRING), 3, '0') || '_' || CAST(ord AS STRING)"


@query(f"""SELECT ord, tile, fov, CAST(tile AS INT) BETWEEN 1102 AND 1104 OR tile = '1107' AS in_tiles, fov IN ('C001R002', 'C003R004') AS in_fovs
FROM (SELECT ord, regexp_extract(id1, '^(?:[^:]*:){{2}}(\\d{{4}})', 1) AS tile, substr(regexp_extract({FOV_ID}, 'C...R....'), 1, 8) AS fov FROM {R}) x""")
def tile_fov_filter(spark, sf_dir):
    df = reads(spark, sf_dir).select("ord", X.tile(F.col("id1")).alias("tile"), X.fov(F.expr(FOV_ID)).alias("fov"))
    return df.select("*", X.in_spec(F.col("tile"), "1102-1104,1107").alias("in_tiles"), X.in_spec(F.col("fov"), "C001R002,C003R004").alias("in_fovs"))


def bad_run(qual: str, below: int, most: int) -> str:
    chars = "".join(chr(c) for c in range(33, 33 + below)).replace("\\", "\\\\").replace("]", "\\]").replace("^", "\\^").replace("-", "\\-").replace("'", "''").replace("[", "\\[")
    return f"length(regexp_extract(substr({qual}, 1, {most}), '^[{chars}]*'))"


def cuts_sql(mate: int, p: dict) -> str:
    """ord, len, head, tail and the kinds' cuts of a mate, as SQL."""
    seq, qual = f"seq{mate}", f"qual{mate}"
    ht, tt = p["hard_trim"][2 * mate - 2 : 2 * mate] if "hard_trim" in p else (0, 0)
    hlq = bad_run(qual, *p["trim_bad_head"]) if "trim_bad_head" in p else "0"
    tlq = bad_run(f"reverse({qual})", *p["trim_bad_tail"]) if "trim_bad_tail" in p else "0"
    tg = f"length(regexp_extract({seq}, '[Gg]*$'))"
    tg = f"CASE WHEN {tg} >= {p['poly_g']} THEN {tg} ELSE 0 END" if "poly_g" in p else "0"
    return f"(SELECT *, greatest(ht, hlq) AS head, greatest(tt, tlq, tg) AS tail FROM (SELECT *, length({seq}) AS len, {ht} AS ht, {tt} AS tt, {hlq} AS hlq, {tlq} AS tlq, {tg} AS tg FROM {R}) y)"


def trimmed_sql(p: dict, mate: int = 1) -> str:
    cut = "greatest(0, len - head - tail)"
    return f"SELECT ord, substr(seq{mate}, head + 1, {cut}) AS tseq{mate}, substr(qual{mate}, head + 1, {cut}) AS tqual{mate} FROM {cuts_sql(mate, p)} z"


def trim_query(name: str, p: dict) -> None:
    def own(spark, sf_dir):
        return trims.with_trim(reads(spark, sf_dir), QCParams(**p)).select("ord", "tseq1", "tqual1", "tseq2", "tqual2")

    own.__name__ = name
    query(f"SELECT ord, tseq1, tqual1, tseq2, tqual2 FROM ({trimmed_sql(p, 1)}) a JOIN ({trimmed_sql(p, 2)}) b USING (ord)")(own)


trim_query("trim_hard", {"hard_trim": TRIMS["hard_trim"]})
trim_query("trim_lowqual", {"trim_bad_head": TRIMS["trim_bad_head"], "trim_bad_tail": TRIMS["trim_bad_tail"]})
trim_query("trim_polyg", {"poly_g": TRIMS["poly_g"]})
trim_query("trim_all", TRIMS)

#: Tests of the cascade queries.
TESTS = {"rmdup": True, "tiles": "1103", "max_n": 0.05, "max_a": 0.36, "poly_x": 8, "max_low_quality": 0.1, "min_mean_quality": 24, "max_length": 126, **TRIMS}
#: Those whose order SE and PE share, as (reason, SQL condition of a mate).
CONDITIONS = [
    ("short", "length(tseq{m}) < 30"), ("long", "length(tseq{m}) > 126"), ("n_ratio", f"{ratio(n_of('N', 'seq{m}'), 'length(seq{m})')} >= {real('0.05')}"),
    ("high_a", f"{ratio(n_of('A', 'seq{m}'), 'length(seq{m})')} >= {real('0.36')}"), ("poly_x", "regexp_matches(seq{m}, 'A{{8}}|C{{8}}|G{{8}}|T{{8}}|N{{8}}')"),
    ("low_quality", f"{ratio(count_if('qual{m}', 'q <= 5'), 'length(qual{m})')} >= {real('0.1')}"), ("mean_quality", f"{ratio('list_sum(' + codes('qual{m}') + ')', 'length(qual{m})')} < {real('24')}"),
]


def judged_sql(paired: bool) -> str:
    """ord, reason and code of every read, with its raw and trimmed columns."""
    fit = lambda cond, m: "(" + cond.replace("{{", "{").replace("}}", "}").replace("{m}", str(m)) + ")"
    key = "seq1 || seq2" if paired else "seq1"
    arms = [("duplicate", "dup", "3" if paired else "1"), ("tile", "regexp_extract(id1, '^(?:[^:]*:){2}(\\d{4})', 1) = '1103'", "1")]
    for name, cond in CONDITIONS:
        a, b = fit(cond, 1), fit(cond, 2)
        arms.append((name, f"{a} OR {b}" if paired else a, f"CAST({a} AS INT) + 2 * CAST({b} AS INT)" if paired else "1"))
    reason = "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, c, _ in arms) + " END"
    code = "CASE " + " ".join(f"WHEN {c} THEN {k}" for _, c, k in arms) + " ELSE 0 END"
    p = TRIMS if paired else TRIMS | {"hard_trim": TRIMS["hard_trim"][:2]}
    both = f"SELECT r.*, tseq1, tqual1{', tseq2, tqual2' if paired else ''}, row_number() OVER (PARTITION BY {key} ORDER BY r.ord) > 1 AS dup FROM {R} JOIN ({trimmed_sql(p, 1)}) a ON a.ord = r.ord"
    both += f" JOIN ({trimmed_sql(p, 2)}) b ON b.ord = r.ord" if paired else ""
    return f"SELECT *, {reason} AS reason, {code} AS code FROM ({both}) j"


def judged(spark, sf_dir, paired: bool = True) -> DataFrame:
    p = QCParams(paired=paired, **(TESTS if paired else TESTS | {"hard_trim": TESTS["hard_trim"][:2]}))
    return cascade.judge(reads(spark, sf_dir), p)


@query(f"SELECT ord, reason, code FROM ({judged_sql(True)}) x")
def cascade_pe(spark, sf_dir):
    return judged(spark, sf_dir).select("ord", "reason", "code")


@query(f"SELECT ord, reason, code FROM ({judged_sql(False)}) x")
def cascade_se(spark, sf_dir):
    return judged(spark, sf_dir, False).select("ord", "reason", "code")


@query(f"""SELECT ord, CASE WHEN length(seq1) > 128 THEN 'long' WHEN {ratio(count_if('qual1', 'q <= 5'), 'length(qual1)')} >= {real('0.1')} THEN 'low_quality'
WHEN {ratio(n_of('A', 'seq1'), 'length(seq1)')} >= {real('0.36')} THEN 'high_a' WHEN length(seq1) < 26 THEN 'short' END AS reason FROM {R}""")
def cascade_srna_order(spark, sf_dir):
    p = QCParams.srna(max_length=128, min_length=26, max_low_quality=0.1, max_a=0.36)
    df = reads(spark, sf_dir).withColumn("ada1", F.lit(-1)).withColumn("five1", F.lit(False))
    return cascade.with_reason(trims.with_trim(df, p), p).select("ord", "reason")


REPORT = "count(*) AS total, count(CASE WHEN code IN (1, 3) THEN 1 END) AS mate1, count(CASE WHEN code IN (2, 3) THEN 1 END) AS mate2, count(CASE WHEN code = 3 THEN 1 END) AS \"both\""


@query(f"WITH j AS (SELECT reason, code FROM ({judged_sql(True)}) x WHERE reason IS NOT NULL) SELECT reason, {REPORT} FROM j GROUP BY reason UNION ALL SELECT 'total', {REPORT} FROM j")
def filter_report(spark, sf_dir):
    return reports.filter_report(judged(spark, sf_dir))


@query(f"SELECT id1 || '/1' AS oid1, translate(tseq1, 'Tt', 'UU') AS oseq1, translate(tqual1, '{FROM}', '{TO}') AS oqual1, id2 || '/2' AS oid2, translate(tseq2, 'Tt', 'UU') AS oseq2, translate(tqual2, '{FROM}', '{TO}') AS oqual2 FROM ({judged_sql(True)}) x WHERE reason IS NULL")
def clean_output(spark, sf_dir):
    p = QCParams(**TESTS, mate_suffix=True, base_convert=("T", "U"), phred_out=64)
    return fastq.finished(cascade.clean(judged(spark, sf_dir)), p).select("oid1", "oseq1", "oqual1", "oid2", "oseq2", "oqual2")


DUP = f"SELECT *, row_number() OVER (PARTITION BY seq1 || seq2 ORDER BY ord) > 1 AS dup FROM {R}"


@query(f"SELECT ord, dup FROM ({DUP}) x")
def dedup(spark, sf_dir):
    return cascade.with_duplicates(reads(spark, sf_dir), QCParams()).select("ord", "dup")


HOT = f"SELECT ord, row_number() OVER (PARTITION BY CASE WHEN ord % 3 = 0 THEN '' ELSE seq1 || seq2 END ORDER BY ord) > 1 AS dup FROM {R}"


@query(HOT)
def dedup_hot(spark, sf_dir):
    """One sequence is a third of all reads."""
    hot = lambda m: F.when(F.col("ord") % 3 == 0, "").otherwise(F.col(f"seq{m}"))
    return cascade.with_duplicates(reads(spark, sf_dir).select("ord", hot(1).alias("seq1"), hot(2).alias("seq2")), QCParams()).select("ord", "dup")


@query(f"SELECT ord, seq1, seq2 FROM ({DUP}) x WHERE dup")
def duplicate_sink(spark, sf_dir):
    return selection.duplicates(reads(spark, sf_dir), "seq1", "seq2").select("ord", "seq1", "seq2")


@query(f"SELECT ord FROM ({DUP}) x WHERE dup")
def dedup_by_hash(spark, sf_dir):
    return selection.likely_duplicates(reads(spark, sf_dir), "seq1", "seq2").select("ord")


CLEAN = f"SELECT ord FROM {R} WHERE length(seq1) >= 30"


def long_reads(spark, sf_dir) -> DataFrame:
    return reads(spark, sf_dir).where("length(seq1) >= 30").select("ord")


@query(f"SELECT ord FROM ({CLEAN}) x ORDER BY ord LIMIT 500")
def head_limit(spark, sf_dir):
    return selection.head(long_reads(spark, sf_dir), 500)


@query(f"SELECT ord FROM (SELECT ord, row_number() OVER (ORDER BY ord) - 1 AS rn, count(*) OVER () AS total FROM ({CLEAN}) x) y WHERE rn % (total // 700) = 0 AND rn < (total // 700) * 700")
def systematic_sample(spark, sf_dir):
    return selection.sample(long_reads(spark, sf_dir), 700)


@query(f"SELECT ord, CAST((row_number() OVER (ORDER BY ord) - 1) // 400 AS INT) AS split FROM ({CLEAN}) x")
def split_files(spark, sf_dir):
    return selection.split(long_reads(spark, sf_dir), 400)


STAGED = f"WITH j AS (SELECT * FROM ({judged_sql(True)}) x), s AS (" + " UNION ALL ".join(
    f"SELECT '{stage}' AS stage, {m} AS mate, {t}seq{m} AS seq, {t}qual{m} AS qual FROM j{' WHERE reason IS NULL' if stage == 'clean' else ''}" for stage, t in (("raw", ""), ("trim", "t"), ("clean", "t")) for m in (1, 2)
) + ")"


@query(f"{STAGED} SELECT stage, mate, count(*) AS reads, sum(length(seq)) AS bases, {', '.join(f'sum({n_of(b, "seq")}) AS {b.lower()}' for b in 'ACGTN')}, sum({count_if('qual', 'q >= 20')}) AS q20, sum({count_if('qual', 'q >= 30')}) AS q30, max(length(seq)) AS max_length FROM s GROUP BY stage, mate")
def general_stats(spark, sf_dir):
    p = QCParams(**TESTS)
    return reports.general_stats(reports.histograms(judged(spark, sf_dir), p, reports.STAGES)).drop("mean_length")


def histograms(spark, sf_dir) -> DataFrame:
    return reports.histograms(judged(spark, sf_dir), QCParams(**TESTS))


def cells(column: str) -> str:
    return f"{STAGED}, c AS (SELECT stage, mate, pos, {'ascii(sym) - 33' if column == 'qual' else 'sym'} AS v, count(*) AS n FROM (SELECT stage, mate, unnest(string_split({column}, '')) AS sym, generate_subscripts(string_split({column}, ''), 1) AS pos FROM s WHERE stage <> 'trim' AND length({column}) > 0) u GROUP BY ALL)"


@query(f"{cells('seq')} SELECT stage, mate, pos, sum(n) AS total, {', '.join(f"sum(CASE WHEN v = '{b}' THEN n ELSE 0 END) AS {b.lower()}" for b in 'ACGTN')} FROM c GROUP BY stage, mate, pos")
def base_by_pos(spark, sf_dir):
    return reports.base_by_position(histograms(spark, sf_dir)).select("stage", "mate", "pos", "total", *"acgtn")


SHARES = (("p10", 1, 10), ("lower", 1, 4), ("median", 1, 2), ("upper", 3, 4), ("p90", 9, 10))


@query(f"""{cells('qual')}, u AS (SELECT *, sum(n) OVER (PARTITION BY stage, mate, pos ORDER BY v) AS upto, sum(n) OVER (PARTITION BY stage, mate, pos) AS total FROM c)
SELECT stage, mate, pos, sum(n) AS total, CAST(sum(v * n) // sum(n) AS INT) AS mean, {', '.join(f'min(CASE WHEN upto > total * {a} // {b} THEN v END) AS "{name}"' for name, a, b in SHARES)} FROM u GROUP BY stage, mate, pos""")
def qual_by_pos(spark, sf_dir):
    return reports.quality_by_position(histograms(spark, sf_dir))


@query(f"{cells('qual')} SELECT stage, mate, pos, sum(n) AS total, sum(CASE WHEN v >= 20 THEN n ELSE 0 END) AS q20, sum(CASE WHEN v >= 30 THEN n ELSE 0 END) AS q30 FROM c GROUP BY stage, mate, pos")
def q20q30_by_pos(spark, sf_dir):
    return reports.good_by_position(histograms(spark, sf_dir)).select("stage", "mate", "pos", "total", "q20", "q30")


def trim_cells_sql() -> str:
    parts = []
    for m in (1, 2):
        c = f"SELECT c.*, j.reason FROM {cuts_sql(m, TRIMS)} c JOIN j ON j.ord = c.ord"
        head = "CASE WHEN head = 0 THEN NULL WHEN ht >= hlq THEN 'ht' ELSE 'hlq' END"
        tail = "CASE WHEN tail = 0 THEN NULL WHEN tt = tail THEN 'tt' WHEN tlq = tail THEN 'tlq' ELSE 'tg' END"
        for kind, pos in ((head, "least(head, len)"), (tail, "greatest(1, len - tail + 1)")):
            for stage in ("raw", "clean"):
                parts.append(f"SELECT '{stage}' AS stage, {m} AS mate, {kind} AS kind, {pos} AS pos FROM ({c}) c{m}{' WHERE reason IS NULL' if stage == 'clean' else ''}")
    return f"WITH j AS (SELECT ord, reason FROM ({judged_sql(True)}) x) SELECT stage, mate, kind, CAST(pos AS INT) AS pos, count(*) AS n FROM ({' UNION ALL '.join(parts)}) t WHERE kind IS NOT NULL GROUP BY ALL"


@query(trim_cells_sql())
def trim_pos_stats(spark, sf_dir):
    return reports.trim_positions(judged(spark, sf_dir), QCParams(**TESTS))


SEGMENTS = f"""WITH b AS ({BARCODES}), e AS (SELECT segment, arg_max(barcode_id, barcode_id) AS id FROM (
SELECT substr(barcode, 1, CAST(spot AS INT) - 1) || base || substr(barcode, CAST(spot AS INT) + 1) AS segment, barcode_id FROM b, range(1, 11) t(spot), (VALUES ('A'), ('C'), ('G'), ('T')) v(base)) x GROUP BY segment),
d AS (SELECT r.*, e1.id AS b1, e2.id AS b2, e3.id AS b3 FROM ({BARCODED}) r LEFT JOIN e e1 ON e1.segment = substr(seq2, 101, 10) LEFT JOIN e e2 ON e2.segment = substr(seq2, 117, 10) LEFT JOIN e e3 ON e3.segment = substr(seq2, 133, 10)),
f AS (SELECT *, CASE WHEN b1 IS NULL OR b2 IS NULL OR b3 IS NULL THEN NULL ELSE b1 || '_' || b2 || '_' || b3 END AS code FROM d)"""


def barcoded(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    df = reads(spark, sf_dir, BARCODED)
    return df, reads(spark, sf_dir, BARCODES).withColumn("ord", F.col("barcode_id").cast("long"))


@query(f"{SEGMENTS} SELECT ord, coalesce(code, '0_0_0') AS barcode, replace(id1, '/1', '') || '#' || coalesce(code, '0_0_0') || '/1' AS id1, substr(seq2, 1, 100) AS seq2 FROM f")
def barcode_demux(spark, sf_dir):
    df, own = barcoded(spark, sf_dir)
    return barcodes.with_barcodes(df, own, QCParams(module="filterStLFR")).select("ord", "barcode", "id1", "seq2")


@query(f"{SEGMENTS} SELECT count(*) AS pairs, count(code) AS pairs_with_barcode, count(DISTINCT code) AS distinct_barcodes, (SELECT count(*) * count(*) * count(*) FROM b) AS possible_barcodes FROM f")
def barcode_stats(spark, sf_dir):
    return filter_barcoded(*barcoded(spark, sf_dir), QCParams(module="filterStLFR"))[1]


@query(f"SELECT ord, strpos(seq1, '{ADAPTER1}') - 1 AS pos FROM {R} WHERE strpos(seq1, '{ADAPTER1}') > 0")
def adapter_full_match(spark, sf_dir):
    """Exact and whole adapters only: no mismatch, a run of the whole length, nothing cut off."""
    p = QCParams(adapters1=(ADAPTER1,), approx1=Approx(0, 1.0, 32))
    return reads(spark, sf_dir).select("ord", "seq1", M.adapter_position_of(F.col("seq1"), p, 1).alias("pos")).where(F.substr("seq1", F.col("pos") + 1, F.lit(32)) == ADAPTER1).drop("seq1")


def alignments_sql(size: int, mismatches: int, edge: int) -> str:
    """The alignments of an adapter of a size with reads of length len, in order: k, spot, skip, n, allowed, res."""
    g5, g = (size - 5) // (mismatches + 1), (size - edge) // (mismatches + 1)
    return f"""SELECT len, i AS k, 0 AS spot, i AS skip, {size} - i AS n, ({size} - i) // {g5} AS allowed, 0 AS res FROM lens, range(1, 6) t(i) WHERE {size} - i <= len
UNION ALL SELECT len, 10 + i, i, 0, {size}, {mismatches}, i FROM lens, range(0, 200) t(i) WHERE i <= len - {size}
UNION ALL SELECT len, 1000 + i, len - i, 0, i, (i - {edge}) // {g}, len - i FROM lens, range({edge}, {size}) t(i) WHERE i <= len"""


def adapter_sql(seq: str, adapter: str, mismatches: int = 2, run: int = 16, edge: int = 6) -> str:
    """ord and pos of the first hit. A mask of 1 (equal) and 0 hits if at most ``allowed`` zeros come before a run, or in all."""
    mask = f"array_to_string(list_transform(range(1, n + 1), lambda c: CASE WHEN substr(s, spot + c, 1) = substr('{adapter}', skip + c, 1) THEN '1' ELSE '0' END), '')"
    hits = " OR ".join(f"(allowed = {a} AND regexp_matches(mask, '^(1*0){{0,{a}}}(1{{{run}}}|1*$)'))" for a in range(6))
    return f"""WITH q AS (SELECT ord, {seq} AS s, length({seq}) AS len FROM {R}), lens AS (SELECT DISTINCT len FROM q), p AS ({alignments_sql(len(adapter), mismatches, edge)}),
m AS (SELECT ord, k, res, allowed, {mask} AS mask FROM q JOIN p USING (len)), h AS (SELECT ord, arg_min(res, k) AS pos FROM m WHERE {hits} GROUP BY ord)
SELECT q.ord, coalesce(pos, -1) AS pos FROM q LEFT JOIN h ON h.ord = q.ord"""


@query(f"SELECT a.ord, a.pos AS pos1, b.pos AS pos2 FROM ({adapter_sql('seq1', ADAPTER1)}) a JOIN ({adapter_sql('seq2', ADAPTER2)}) b ON a.ord = b.ord")
def adapter_pos(spark, sf_dir):
    p = QCParams(adapters1=(ADAPTER1,), adapters2=(ADAPTER2,))
    return reads(spark, sf_dir).select("ord", M.adapter_position_of(F.col("seq1"), p, 1).alias("pos1"), M.adapter_position_of(F.col("seq2"), p, 2).alias("pos2"))


def contam_sql(seq: str, contam: str, ratio_: float, mismatches: int = 2, edge: int = 6) -> str:
    """ord and pos of the first hit of a contaminant. N of the read is left out of a mask; partial runs get longer."""
    size = len(contam)
    run, g = math.ceil(size * ratio_), (size - edge) // (mismatches + 1)
    rise = int((size - edge) / (run - 6)) if run != 6 else 0
    need = f"7 + (i - {edge}) // {rise}" if rise else "7"
    plan = f"""SELECT len, i AS k, 0 AS spot, {size} - i AS skip, i AS n, (i - {edge}) // {g} AS allowed, {need} AS run, 0 AS res FROM lens, range({edge}, {size}) t(i) WHERE i <= len
UNION ALL SELECT len, 100 + i, i, 0, {size}, {mismatches}, {run}, i FROM lens, range(0, 200) t(i) WHERE i <= len - {size}
UNION ALL SELECT len, 1000 + i, len - i, 0, i, (i - {edge}) // {g}, {need}, len - i FROM lens, range({edge}, {size}) t(i) WHERE i <= len"""
    mask = f"array_to_string(list_transform(range(1, n + 1), lambda c: CASE WHEN substr(s, spot + c, 1) = substr('{contam}', skip + c, 1) THEN '1' WHEN substr(s, spot + c, 1) = 'N' THEN '' ELSE '0' END), '')"
    kinds = {(mismatches, run)} | {((i - edge) // g, 7 + (i - edge) // rise if rise else 7) for i in range(edge, size)}
    hits = " OR ".join(f"(allowed = {a} AND run = {r} AND regexp_matches(mask, '^(1*0){{0,{a}}}(1{{{r}}}|1*$)'))" for a, r in sorted(kinds))
    return f"""WITH q AS (SELECT ord, {seq} AS s, length({seq}) AS len FROM {R}), lens AS (SELECT DISTINCT len FROM q), p AS ({plan}),
m AS (SELECT ord, k, res, allowed, run, {mask} AS mask FROM q JOIN p USING (len)), h AS (SELECT ord, arg_min(res, k) AS pos FROM m WHERE {hits} GROUP BY ord)
SELECT q.ord, coalesce(pos, -1) AS pos FROM q LEFT JOIN h ON h.ord = q.ord"""


#: Contaminants of the scan and their ratios.
CONTAMS = ((ADAPTER1, 0.4), ("GGGGGGGGGGGGGGGGGGGG", 0.6))


@query(f"""SELECT a.ord, CASE WHEN a.pos BETWEEN 0 AND 29 OR b.pos < 0 THEN a.pos WHEN a.pos < 0 THEN b.pos ELSE least(a.pos, b.pos) END AS pos1
FROM ({contam_sql('seq1', *CONTAMS[0])}) a JOIN ({contam_sql('seq1', *CONTAMS[1])}) b ON a.ord = b.ord""")
def contam_scan(spark, sf_dir):
    """The smallest place of two contaminants; the second isn't sought where the first lies below the least length."""
    p = QCParams(contams1=tuple(c for c, _ in CONTAMS), contam_ratios=tuple(r for _, r in CONTAMS))
    return reads(spark, sf_dir).select("ord", M.contaminant_position_of(F.col("seq1"), p, 1).alias("pos1"))


@query()
def global_contam_scan(spark, sf_dir):
    p = QCParams(global_contams=(ADAPTER1,), global_ratios=(0.5,), global_mismatches=(1,))
    return reads(spark, sf_dir).select("ord", M.global_positions_of(F.col("seq1"), p).alias("x")).select("ord", "x.five", "x.three")


def small_rna(spark, sf_dir) -> DataFrame:
    """Inserts of 15 to 45 bases before the 3' adapter, some after the 5' adapter's end."""
    insert = F.substr("seq1", F.lit(1), (15 + F.col("ord") % 31).cast("int"))
    seq = F.concat(F.when(F.col("ord") % 19 == 0, ADAPTER2[-10:]).otherwise(""), F.when(F.col("ord") % 23 == 1, "").otherwise(insert), F.when(F.col("ord") % 13 == 0, "").otherwise(ADAPTER1[:20]))
    return reads(spark, sf_dir).select("ord", "id1", seq.alias("seq1")).select("ord", "id1", "seq1", F.rpad(F.lit("F"), F.length("seq1"), "F").alias("qual1"))


SMALL_RNA = f"""SELECT ord, id1, CASE WHEN ord % 19 = 0 THEN '{ADAPTER2[-10:]}' ELSE '' END || CASE WHEN ord % 23 = 1 THEN '' ELSE substr(seq1, 1, CAST(15 + ord % 31 AS INT)) END
|| CASE WHEN ord % 13 = 0 THEN '' ELSE '{ADAPTER1[:20]}' END AS seq FROM {R}"""
#: Places of the 3' adapter by the best of its offsets, in order, and whether the 5' adapter is there.
SRNA = f"""WITH q AS (SELECT *, length(seq) AS len FROM ({SMALL_RNA}) s),
o AS (SELECT ord, 0 AS k, 0 AS spot, 2 AS skip FROM q UNION ALL SELECT ord, 1, 0, 1 FROM q UNION ALL SELECT ord, 2 + i, i, 0 FROM q, range(0, 200) t(i) WHERE i <= len - 5),
c AS (SELECT ord, k, spot, substr(seq, spot + 1, least(32 - skip, len - spot)) AS x, substr('{ADAPTER1}', skip + 1, least(32 - skip, len - spot)) AS y FROM o JOIN q USING (ord) WHERE len >= 5 AND spot <= len - 5),
w AS (SELECT ord, k, spot, hamming(x, y) - (length(x) - length(replace(x, 'N', ''))) AS bad, length(x) - hamming(x, y) AS good FROM c),
f AS (SELECT ord, list(struct_pack(spot := spot, bad := bad, good := good) ORDER BY k) AS l FROM w WHERE bad <= 4 AND good + bad >= 5 AND good > 0 AND {ratio('bad', 'good')} <= {real('0.4')} GROUP BY ord),
a AS (SELECT ord, list_reduce(l, lambda b, x: CASE WHEN x.bad <= b.bad AND x.good >= b.good THEN x ELSE b END).spot AS ada1 FROM f),
o5 AS (SELECT ord, 0 AS spot, i AS skip FROM q, range(1, 27) t(i) UNION ALL SELECT ord, i, 0 FROM q, range(0, 200) t(i) WHERE i <= greatest(0, len - 6)),
c5 AS (SELECT ord, len, substr(seq, spot + 1, least(32 - skip, len - spot)) AS x, substr('{ADAPTER2}', skip + 1, least(32 - skip, len - spot)) AS y FROM o5 JOIN q USING (ord) WHERE len > spot),
w5 AS (SELECT *, length(x) - hamming(x, y) AS good FROM c5 WHERE hamming(x, y) <= 4),
b AS (SELECT DISTINCT ord FROM w5 WHERE (len < 12 OR contains(array_to_string(list_transform(range(1, length(x) + 1), lambda c: CASE WHEN substr(x, c, 1) = substr(y, c, 1) THEN '1' ELSE '0' END), ''), '111111'))
AND (CAST(good AS DOUBLE) / len >= CAST(0.8 AS DOUBLE) OR CAST(good AS DOUBLE) / 32 >= CAST(0.8 AS DOUBLE)))
SELECT q.ord, seq AS seq1, CAST(coalesce(ada1, -1) AS INT) AS ada1, b.ord IS NOT NULL AS five1 FROM q LEFT JOIN a ON a.ord = q.ord LEFT JOIN b ON b.ord = q.ord"""


@query(SRNA)
def srna_adapters(spark, sf_dir):
    p = QCParams.srna(adapters1=(ADAPTER2,), adapters2=(ADAPTER1,))
    return cascade.with_matches(small_rna(spark, sf_dir), p).select("ord", "seq1", "ada1", "five1")


@query(f"""SELECT ord, CASE WHEN length(tseq1) > 49 THEN 'long' WHEN ada1 < 0 THEN 'no_3_adapter' WHEN ada1 <= 2 THEN 'insert_null' WHEN five1 THEN 'has_5_adapter' WHEN length(tseq1) < 18 THEN 'short' END AS reason, tseq1
FROM (SELECT *, CASE WHEN ada1 > 2 THEN substr(seq1, 1, ada1) ELSE seq1 END AS tseq1 FROM ({SRNA}) x) y""")
def filter_srna(spark, sf_dir):
    p = QCParams.srna(adapters1=(ADAPTER2,), adapters2=(ADAPTER1,), adapter_mode="trim")
    return filter_reads(small_rna(spark, sf_dir), p).judged.select("ord", "reason", "tseq1")


@query(f"""SELECT r.ord, CASE WHEN length(seq1) < 30 THEN 'short' WHEN pos >= 0 THEN 'contaminant' WHEN {ratio(n_of('N', 'seq1'), 'length(seq1)')} >= {real('0.05')} THEN 'n_ratio' END AS reason
FROM {R} JOIN ({contam_sql('seq1', *CONTAMS[0])}) c ON c.ord = r.ord""")
def discard_contaminants(spark, sf_dir):
    p = QCParams(paired=False, contams1=(CONTAMS[0][0],), contam_ratios=(CONTAMS[0][1],), max_low_quality=None)
    return filter_reads(reads(spark, sf_dir), p).judged.select("ord", "reason")


@query(f"""SELECT a.ord, CASE WHEN a.pos >= 0 THEN substr(seq1, 1, a.pos) ELSE seq1 END AS tseq1, CASE WHEN b.pos >= 0 THEN substr(seq2, 1, b.pos) ELSE seq2 END AS tseq2
FROM {R} JOIN ({adapter_sql('seq1', ADAPTER1)}) a ON a.ord = r.ord JOIN ({adapter_sql('seq2', ADAPTER2)}) b ON b.ord = r.ord""")
def trim_adapters(spark, sf_dir):
    p = QCParams(adapters1=(ADAPTER1,), adapters2=(ADAPTER2,), adapter_mode="trim")
    return trims.with_trim(cascade.with_matches(reads(spark, sf_dir), p), p).select("ord", "tseq1", "tseq2")


def filter_pe_sql() -> str:
    arms = [("duplicate", "dup", "3")]
    conditions = [c for c in CONDITIONS if c[0] in ("short", "n_ratio")]
    conditions += [("low_quality", f"{ratio(count_if('qual{m}', 'q <= 5'), 'length(qual{m})')} >= {real('0.5')}"), ("mean_quality", f"{ratio('list_sum(' + codes('qual{m}') + ')', 'length(qual{m})')} < {real('20')}"), ("adapter", "pos{m} >= 0")]
    for name, cond in conditions:
        x, y = (cond.replace("tseq", "seq").replace("{m}", m) for m in "12")
        arms.append((name, f"({x}) OR ({y})", f"CAST(({x}) AS INT) + 2 * CAST(({y}) AS INT)"))
    reason, code = ("CASE " + " ".join(f"WHEN {a[1]} THEN {f(a)}" for a in arms) for f in (lambda a: f"'{a[0]}'", lambda a: a[2]))
    both = f"SELECT d.*, a.pos AS pos1, b.pos AS pos2 FROM ({DUP}) d JOIN ({adapter_sql('seq1', ADAPTER1)}) a ON a.ord = d.ord JOIN ({adapter_sql('seq2', ADAPTER2)}) b ON b.ord = d.ord"
    return f"SELECT ord, {reason} END AS reason, {code} ELSE 0 END AS code FROM ({both}) x"


@query(filter_pe_sql())
def filter_pe(spark, sf_dir):
    """The whole of a paired run with adapters, copies and the default limits."""
    p = QCParams(adapters1=(ADAPTER1,), adapters2=(ADAPTER2,), rmdup=True, min_mean_quality=20)
    return filter_reads(reads(spark, sf_dir), p).judged.select("ord", "reason", "code")


MATE2 = f"CASE WHEN ord % 5 = 0 THEN {revcomp('substr(seq1, 60)')} || substr(seq2, 1, 59) ELSE seq2 END"


@query(f"""WITH q AS (SELECT ord, replace(seq1, 'N', 'x') AS a, {revcomp(MATE2)} AS b FROM {R}),
l AS (SELECT ord, i FROM q, range(20, 200) t(i) WHERE i <= length(a) AND i <= length(b) AND hamming(right(a, i), left(b, i)) <= floor(CAST(0.1 AS DOUBLE) * i))
SELECT q.ord, CAST(coalesce(max(i), -1) AS INT) AS overlap FROM q LEFT JOIN l ON l.ord = q.ord GROUP BY q.ord""")
def pe_overlap(spark, sf_dir):
    """Mates whose ends overlap: read 2 is made from read 1's reverse complement for one pair in five."""
    mate = F.when(F.col("ord") % 5 == 0, F.concat(X.reverse_complement(F.substr("seq1", F.lit(60))), F.substr("seq2", F.lit(1), F.lit(59)))).otherwise(F.col("seq2"))
    p = QCParams(overlap=20)
    return reads(spark, sf_dir).withColumn("seq2", mate).select("ord", M.overlap_of(F.col("seq1"), F.col("seq2"), p).alias("overlap"))


@query(f"""WITH q AS (SELECT *, replace(seq1, 'N', 'x') AS a, {revcomp('m2')} AS b FROM (SELECT *, {MATE2} AS m2 FROM {R}) p),
l AS (SELECT DISTINCT ord FROM q, range(20, 200) t(i) WHERE i <= length(a) AND i <= length(b) AND hamming(right(a, i), left(b, i)) <= floor(CAST(0.1 AS DOUBLE) * i))
SELECT q.ord, CASE WHEN length(seq1) < 30 OR length(m2) < 30 THEN 'short' WHEN {ratio(n_of('N', 'seq1'), 'length(seq1)')} >= {real('0.05')} OR {ratio(n_of('N', 'm2'), 'length(m2)')} >= {real('0.05')} THEN 'n_ratio'
WHEN l.ord IS NOT NULL THEN 'overlap' END AS reason FROM q LEFT JOIN l ON l.ord = q.ord""")
def discard_overlaps(spark, sf_dir):
    p = QCParams(overlap=20, max_low_quality=None)
    mate = F.when(F.col("ord") % 5 == 0, F.concat(X.reverse_complement(F.substr("seq1", F.lit(60))), F.substr("seq2", F.lit(1), F.lit(59)))).otherwise(F.col("seq2"))
    df = reads(spark, sf_dir).withColumn("seq2", mate).withColumn("qual2", F.rpad(F.lit("F"), F.length("seq2"), "F"))
    return filter_reads(df, p).judged.select("ord", "reason")


ODD_ID = "CASE WHEN ord % 9 = 0 THEN 'x' || id2 WHEN ord % 11 = 0 THEN replace(id2, '/2', '') ELSE id2 END"


@query(f"SELECT ord FROM (SELECT ord, id1, {ODD_ID} AS i2 FROM {R}) x WHERE NOT (ends_with(id1, '/1') AND ends_with(i2, '/2') AND regexp_replace(id1, '/1$', '') = regexp_replace(i2, '/2$', ''))")
def barcode_bad_ids(spark, sf_dir):
    return barcodes.bad_ids(reads(spark, sf_dir).withColumn("id2", F.expr(ODD_ID))).select("ord")


SAM = """SELECT 2 * ord + m.mate - 1 AS ord, 'r' || ord AS qname, CASE WHEN m.mate = 1 THEN CASE WHEN ord % 4 = 1 THEN 81 ELSE 65 END ELSE 129 END AS flag,
CASE WHEN m.mate = 1 THEN CASE WHEN ord % 4 = 1 THEN {rc} ELSE seq1 END ELSE seq2 END AS seq, CASE WHEN m.mate = 1 THEN CASE WHEN ord % 4 = 1 THEN reverse(qual1) ELSE qual1 END ELSE qual2 END AS qual
FROM {r} CROSS JOIN (SELECT 1 AS mate UNION ALL SELECT 2) m""".format(rc=revcomp("seq1"), r=R)
SAM_BAD = f"{ratio(n_of('N', 'seq1'), 'length(seq1)')} >= {real('0.05')} OR length(seq1) < 30 OR length(seq2) < 30 OR {ratio(n_of('N', 'seq2'), 'length(seq2)')} >= {real('0.05')}"


@query(f"SELECT s.ord, s.qname, CASE WHEN b.qname IS NULL THEN s.flag ELSE s.flag | 512 END AS flag FROM ({SAM}) s LEFT JOIN (SELECT 'r' || ord AS qname FROM {R} WHERE {SAM_BAD}) b ON b.qname = s.qname")
def sam_qcfail_flag(spark, sf_dir):
    records = reads(spark, sf_dir, SAM).withColumn("flag", F.col("flag").cast("int"))
    return alignments.mark(records, QCParams(max_low_quality=None))[0].select("ord", "qname", "flag")


@query(f"SELECT row_number() OVER (ORDER BY ord) - 1 AS ord, id1, seq1, qual1 FROM {R}")
def fastq_round_trip(spark, sf_dir):
    """Reads written as gzip-compressed FASTQ, in order over the files of a folder, and read back."""
    path = scratch_path(spark, "fastq")
    p = QCParams(paired=False)
    fastq.write_reads(reads(spark, sf_dir), p, [path + ".gz"])
    return fastq.read_fastq(spark, path + ".gz")


@query(f"SELECT CASE WHEN length(seq1) < 30 THEN 'short' WHEN {ratio(n_of('N', 'seq1'), 'length(seq1)')} >= {real('0.05')} THEN 'n_ratio' ELSE 'clean' END AS reason, count(*) AS reads, sum(length(seq1)) AS bases FROM {R} GROUP BY 1")
def stream_filter(spark, sf_dir):
    """Counts that a stream has gathered over FASTQ files in a folder."""
    path, p = scratch_path(spark, "stream"), QCParams(paired=False, max_low_quality=None)
    fastq.write_reads(reads(spark, sf_dir), p, [path + "/in.gz"])
    live.start(live.stream_fastq(spark, path + "/in.gz", files_per_batch=4), p, path + "/out", path + "/state").awaitTermination()
    counts = spark.read.parquet(path + "/out/counts")
    return counts.groupBy("reason").agg(F.sum("reads").alias("reads"), F.sum("bases").alias("bases"))


@query(f"SELECT min(ord) AS ord, count(*) AS records, qname AS id1, arg_min(CASE WHEN flag & 16 <> 0 THEN {revcomp('seq')} ELSE seq END, ord) AS seq1, arg_min(CASE WHEN flag & 16 <> 0 THEN reverse(qual) ELSE qual END, ord) AS qual1 FROM ({SAM}) s GROUP BY qname")
def sam_single(spark, sf_dir):
    """Records of one name as one single-end read: its first."""
    return alignments.grouped(reads(spark, sf_dir, SAM).withColumn("flag", F.col("flag").cast("int")), False)
