"""The discard cascade: the first test that fails names a read's reason, as one column of branches.

Features come from the raw read; only the two length tests see the trimmed one. For pairs a test fails if either mate
fails it, and the code says which: 1, 2, or 3 for both.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixsieve.functions import features as X
from helixsieve.functions import matching as M
from helixsieve.operators.selection import with_copies
from helixsieve.operators.trims import with_trim
from helixsieve.params import QCParams

#: Order of the tests, by kind of library: fixed values of the reference behaviour.
SE_ORDER = ("duplicate", "tile", "fov", "short", "long", "contaminant", "global_contaminant", "n_ratio", "high_a", "poly_x", "low_quality", "mean_quality", "adapter")
PE_ORDER = ("duplicate", "tile", "fov", "short", "long", "global_contaminant", "contaminant", "n_ratio", "high_a", "poly_x", "low_quality", "mean_quality", "overlap", "adapter")
SRNA_ORDER = ("long", "low_quality", "no_3_adapter", "insert_null", "has_5_adapter", "high_a", "poly_x", "short")


def with_matches(df: DataFrame, p: QCParams) -> DataFrame:
    """Add the places of adapters and contaminants that p asks for: ada1, five1, con1, glo1, ..."""
    for mate in p.mates():
        seq = F.col(f"seq{mate}")
        if p.module == "filtersRNA":
            df = df.withColumn("ada1", M.srna_three_prime_of(seq, p)).withColumn("five1", M.srna_five_prime_of(seq, p))
            continue
        if p.adapters1 if mate == 1 else p.adapters2:
            df = df.withColumn(f"ada{mate}", M.adapter_position_of(seq, p, mate))
        if p.contams1 if mate == 1 else p.contams2:
            df = df.withColumn(f"con{mate}", M.contaminant_position_of(seq, p, mate))
        if p.global_contams:
            df = df.withColumn(f"glo{mate}", M.global_positions_of(seq, p))
    if p.overlap is not None and p.paired:
        df = df.withColumn("overlap", M.overlap_of(F.col("seq1"), F.col("seq2"), p))
    return df


def with_duplicates(df: DataFrame, p: QCParams) -> DataFrame:
    """Flag all but the first read, by ord, of each group of equal sequences; of pairs both mates together."""
    return with_copies(df, "dup", *(f"seq{m}" for m in p.mates()))


def tests(df: DataFrame, p: QCParams, mate: int) -> dict[str, Column]:
    """Condition of each test that p switches on for a mate."""
    seq, qual, n = F.col(f"seq{mate}"), F.col(f"qual{mate}"), F.length(f"tseq{mate}")
    length, of = F.length(seq), F.length(qual)
    at_least = lambda count, limit: X.ratio(count, length) >= F.lit(limit).cast("float")
    out: dict[str, Column] = {}
    if p.tiles and mate == 1:
        out["tile"] = X.in_spec(X.tile(F.col("id1"), p.seq_type), p.tiles)
    if p.fovs and mate == 1:
        out["fov"] = X.in_spec(X.fov(F.col("id1")), p.fovs)
    if p.min_length is not None:
        out["short"] = n < p.min_length
    elif p.paired:
        out["short"] = n == 0
    if p.max_length is not None:
        out["long"] = n > p.max_length
    if f"con{mate}" in df.columns and p.contam_mode == "discard":
        out["contaminant"] = F.col(f"con{mate}") >= 0
    if f"glo{mate}" in df.columns and p.contam_mode == "discard":
        out["global_contaminant"] = (F.col(f"glo{mate}.five") >= 0) | (F.col(f"glo{mate}.three") >= 0)
    if p.max_n is not None:
        out["n_ratio"] = at_least(X.count_base(seq, "N"), p.max_n)
    if p.max_a is not None:
        out["high_a"] = at_least(X.count_base(seq, "A"), p.max_a)
    if p.poly_x is not None:
        out["poly_x"] = X.has_run(seq, p.poly_x)
    if p.max_low_quality is not None:
        out["low_quality"] = X.ratio(X.count_up_to(qual, p.low_quality, p.phred_in), of) >= F.lit(p.max_low_quality).cast("float")
    if p.min_mean_quality is not None:
        out["mean_quality"] = X.ratio(X.sum_quality(qual, p.phred_in), of) < F.lit(p.min_mean_quality).cast("float")
    if p.module == "filtersRNA":
        if p.adapters2:
            out["no_3_adapter"] = F.col("ada1") < 0
            out["insert_null"] = F.col("ada1").between(0, 2)
        if p.adapters1:
            out["has_5_adapter"] = F.col("five1")
    elif f"ada{mate}" in df.columns and p.adapter_mode == "discard":
        out["adapter"] = F.col(f"ada{mate}") >= 0
    return out


def order_of(p: QCParams) -> tuple[str, ...]:
    return SRNA_ORDER if p.module == "filtersRNA" else PE_ORDER if p.paired else SE_ORDER


def with_reason(df: DataFrame, p: QCParams) -> DataFrame:
    """Add reason (null: the read is clean) and code (which mates failed)."""
    own = [tests(df, p, m) for m in p.mates()]
    fails = F
    for name in order_of(p):
        if name == "duplicate":
            if "dup" in df.columns:
                fails = fails.when(F.col("dup"), F.struct(F.lit(name).alias("reason"), F.lit(3 if p.paired else 1).alias("code")))
            continue
        if name == "overlap":
            if "overlap" in df.columns:
                fails = fails.when(F.col("overlap") >= 0, F.struct(F.lit(name).alias("reason"), F.lit(3).alias("code")))
            continue
        if not any(name in o for o in own):
            continue
        one, two = (F.coalesce(o.get(name, F.lit(False)), F.lit(False)) for o in (own if p.paired else [*own, {}]))
        code = one.cast("int") + (two.cast("int") * 2 if name in own[-1] or p.paired else F.lit(0))
        fails = fails.when(one | two, F.struct(F.lit(name).alias("reason"), code.alias("code")))
    if fails is F:
        return df.withColumn("reason", F.lit(None).cast("string")).withColumn("code", F.lit(0))
    return df.withColumn("_fails", fails).withColumn("reason", F.col("_fails.reason")).withColumn("code", F.coalesce("_fails.code", F.lit(0))).drop("_fails")


def with_adapters(df: DataFrame, p: QCParams) -> DataFrame:
    """The last test: adapters of reads that have passed all others. Failed reads are not searched (place -1)."""
    for m in p.mates():
        if p.adapters1 if m == 1 else p.adapters2:
            place = M.adapter_position_of(F.when(F.col("reason").isNull(), F.col(f"seq{m}")), p, m)
            df = df.withColumn(f"ada{m}", place)
    one, two = ((F.col(f"ada{m}") >= 0) if f"ada{m}" in df.columns else F.lit(False) for m in (1, 2))
    found = F.col("reason").isNull() & (one | two)
    return df.withColumns({"reason": F.when(found, "adapter").otherwise(F.col("reason")), "code": F.when(found, one.cast("int") + 2 * two.cast("int")).otherwise(F.col("code"))})


def judge(df: DataFrame, p: QCParams) -> DataFrame:
    """Matches, duplicates, trims and reason of raw reads: the whole of a run but for its outputs.

    Where adapters only discard, their test is the last, so reads that fail before are spared the search.
    """
    if p.rmdup and "dup" not in df.columns:
        df = with_duplicates(df, p)
    late = p.adapter_mode == "discard" and p.module != "filtersRNA" and bool(p.adapters1 or p.adapters2)
    rest = replace(p, adapters1=(), adapters2=()) if late else p
    df = with_reason(with_trim(with_matches(df, rest), rest), rest)
    return with_adapters(df, p) if late else df


def clean(judged: DataFrame) -> DataFrame:
    return judged.where("reason is null")


def discarded(judged: DataFrame) -> DataFrame:
    return judged.where("reason is not null")
