"""Trims: every cut is computed from the raw read, the largest head and tail cut win, and one substring is taken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixsieve.functions import features as X
from helixsieve.params import QCParams


def trim_columns(p: QCParams, mate: int) -> dict[str, Column]:
    """The cuts that p switches on, by kind: ht and hlq at the head, tt, ta, tlq and tg at the tail."""
    out: dict[str, Column] = {}
    seq, qual = F.col(f"seq{mate}"), F.col(f"qual{mate}")
    if p.hard_trim and p.module != "filterHts":
        head, tail = p.hard_trim[2 * mate - 2 : 2 * mate]
        out |= {"ht": F.lit(head)} if head else {}
        out |= {"tt": F.lit(tail)} if tail else {}
    if p.trim_bad_head:
        out["hlq"] = X.bad_head(qual, *p.trim_bad_head, p.phred_in)
    if p.trim_bad_tail:
        out["tlq"] = X.bad_tail(qual, *p.trim_bad_tail, p.phred_in)
    if p.adapter_mode == "trim" and p.module == "filtersRNA" and p.adapters2:
        pos = F.col(f"ada{mate}")
        out["ta"] = F.when(pos > 2, F.length(seq) - pos).otherwise(0)
    elif p.adapter_mode == "trim" and (p.adapters1 if mate == 1 else p.adapters2):
        pos = F.col(f"ada{mate}")
        out["ta"] = F.when(pos >= 0, F.length(seq) - pos).otherwise(0)
    if p.poly_g:
        # A small-RNA 3' adapter is cut before the run of G is looked for.
        shown = F.substr(seq, F.lit(1), F.length(seq) - out["ta"]) if p.module == "filtersRNA" and "ta" in out else seq
        run = X.tail_g(shown)
        base = out["ta"] if shown is not seq else F.lit(0)
        out["tg"] = F.when(run >= p.poly_g, run + base).otherwise(0)
    return out


def with_trim(df: DataFrame, p: QCParams) -> DataFrame:
    """Add head and tail cuts (cuts1, ...) and the trimmed read (tseq1, tqual1, ...); drop the index from ids.

    Without a trim the trimmed columns are the raw ones, so a plan holds no work that is switched off.
    """
    for mate in p.mates():
        cuts = trim_columns(p, mate)
        most = lambda names: F.greatest(F.lit(0), F.lit(0), *(cuts[n] for n in names if n in cuts))
        df = df.withColumn(f"cuts{mate}", F.struct(F.length(f"seq{mate}").alias("len"), most(("ht", "hlq")).alias("head"), most(("tt", "ta", "tlq", "tg")).alias("tail"), *(c.alias(n) for n, c in cuts.items())))
        for name in ("seq", "qual"):
            raw, c = F.col(f"{name}{mate}"), F.col(f"cuts{mate}")
            cut = F.substr(raw, c["head"] + 1, F.greatest(F.lit(0), c["len"] - c["head"] - c["tail"]))
            df = df.withColumn(f"t{name}{mate}", cut if cuts else raw)
        if p.remove_index:
            df = df.withColumn(f"id{mate}", X.remove_index(F.col(f"id{mate}"), p.seq_type))
    return df


def winning_cuts(mate: int, cuts: set[str], raw: bool = False) -> tuple[Column, Column]:
    """Kind of the head cut and of the tail cut that won, null without one. Ties: hard before the others, adapter next."""
    c = F.col(f"cuts{mate}")
    zero = lambda n: c[n] if n in cuts else F.lit(0)
    head = F.when(c["head"] == 0, None).when(zero("ht") >= zero("hlq"), "ht").otherwise("hlq")
    tail = F.when(c["tail"] == 0, None)
    for name in ("tt", "ta", "tlq", "tg"):
        tail = tail.when(zero(name) == c["tail"], name)
    return head, tail
