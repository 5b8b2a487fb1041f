"""What a run writes: clean reads, trimmed reads, copies, reports and plots."""

from __future__ import annotations

from pyspark.sql import DataFrame

from helixsieve.plans import plots
from helixsieve.plans.modules import Run
from helixsieve.sources import fastq


def write_report(df: DataFrame, path: str) -> None:
    """A small table as one tab-separated file with a header, in order of its keys."""
    keys = [c for c in ("stage", "mate", "kind", "pos", "reason") if c in df.columns]
    df = df.orderBy(*keys) if keys else df
    df.coalesce(1).write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


def write_run(run: Run, folder: str, *, gzip: bool = True, trimmed: bool = False, copies: bool = False, draw: bool = False) -> None:
    """Write a run below a folder.

    The judged reads and their histograms are kept in memory or on disk meanwhile, for each output reads them; what a
    lost executor held is computed again.
    """
    p, end = run.params, ".gz" if gzip else ""
    run.judged.persist()
    hist = run.histograms().persist()
    try:
        clean = run.clean
        if p.split_reads:
            for m in p.mates():
                fastq.write_split(clean, p, f"{folder}/clean_{m}", m)
        else:
            fastq.write_reads(clean, p, [f"{folder}/clean_{m}.fq{end}" for m in p.mates()])
        if trimmed:
            fastq.write_reads(run.trimmed, p, [f"{folder}/trimmed_{m}.fq{end}" for m in p.mates()])
        if copies:
            raw = run.duplicates.drop(*(f"t{c}{m}" for c in ("seq", "qual") for m in p.mates()))
            fastq.write_reads(raw, p, [f"{folder}/copies_{m}.fq{end}" for m in p.mates()])
        for name, table in run.reports(hist).items():
            write_report(table, f"{folder}/report_{name}")
            if draw and name in plots.DRAWN:
                drawn = plots.DRAWN[name](table.orderBy("stage", "mate", "pos").collect())  # a row a position
                table.sparkSession.createDataFrame([(drawn,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/plot_{name}")
    finally:
        hist.unpersist()
        run.judged.unpersist()
