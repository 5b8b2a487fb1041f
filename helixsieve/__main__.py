"""Command line: ``python -m helixsieve MODULE -1 r1.fq.gz [-2 r2.fq.gz] -o folder [-c config] ...``"""

from __future__ import annotations

import argparse
import sys
from dataclasses import replace

from pyspark.sql import SparkSession

from helixsieve.operators.reports import phred_check
from helixsieve.params import MODULES, QCParams, parse_config, read_adapters
from helixsieve.plans.modules import filter_alignments, filter_barcoded, filter_reads
from helixsieve.plans.output import write_report, write_run
from helixsieve.sources import alignments, fastq

#: Options that set a parameter: letter, parameter, type.
SETTINGS = (("l", "low_quality", int), ("q", "max_low_quality", float), ("m", "min_mean_quality", int), ("x", "max_a", float), ("n", "max_n", float), ("p", "poly_x", int), ("g", "poly_g", int), ("t", "trim", str))


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="helixsieve")
    out.add_argument("module", choices=MODULES)
    out.add_argument("-1", dest="first", required=True, help="FASTQ of mate 1, a list of files, or SAM/BAM")
    out.add_argument("-2", dest="second", help="FASTQ of mate 2")
    out.add_argument("-o", dest="folder", required=True)
    out.add_argument("-c", dest="config", help="file of key=value lines")
    out.add_argument("-f", dest="adapters1", action="append", default=[], help="adapter of mate 1, or a file of them; may be repeated")
    out.add_argument("-r", dest="adapters2", action="append", default=[])
    out.add_argument("-J", dest="trim_adapter", action="store_true", help="trim adapters instead of discarding reads")
    out.add_argument("-L", dest="min_length", type=int)
    out.add_argument("--trimmed", action="store_true", help="also write all reads after trimming")
    out.add_argument("--plots", action="store_true")
    for letter, name, kind in SETTINGS:
        out.add_argument(f"-{letter}", dest=name, type=kind)
    return out


def settings(spark: SparkSession, a: argparse.Namespace) -> QCParams:
    """Parameters of the options, on top of those of the config file."""

    def listed(value: str) -> str | None:
        return None if set(value) <= set("ACGTN") else fastq.read_text(spark, value)

    own: dict = {"module": a.module, "paired": bool(a.second) or a.module in ("filterStLFR", "filterHts")}
    own |= {"min_length": 18, "max_length": 49} if a.module == "filtersRNA" else {}
    own |= parse_config(fastq.read_text(spark, a.config)) if a.config else {}
    own |= {n: read_adapters(v, listed) for n, v in (("adapters1", a.adapters1), ("adapters2", a.adapters2)) if v}
    own |= {n: getattr(a, n) for n in ("min_length", *(n for _, n, _ in SETTINGS)) if n != "trim" and getattr(a, n) is not None}
    if a.trim:
        own["hard_trim"] = tuple(int(x) for x in a.trim.split(","))
    return QCParams(**own | ({"adapter_mode": "trim"} if a.trim_adapter else {}))


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName("helixsieve").getOrCreate()
    p = settings(spark, a)
    if a.module == "filterHts":
        binary = a.first.endswith(".bam")
        records = (alignments.read_bam if binary else alignments.read_sam)(spark, a.first)
        header = (alignments.read_bam_header if binary else alignments.read_header)(spark, a.first)
        first = records.orderBy("ord").first()  # its paired flag decides, as for the whole file
        marked, rejected = filter_alignments(records, replace(p, paired=bool(first and first["flag"] & 1)))
        if binary:
            alignments.write_bam(marked, f"{a.folder}/marked.bam", header=header)
        else:
            alignments.write_sam(marked, f"{a.folder}/marked.sam", header=header)
        rejected.write.mode("overwrite").text(f"{a.folder}/rejected")
        return
    if "inputAsList" in p.extra:
        reads = fastq.read_file_lists(spark, a.first, a.second)
    elif p.paired:
        reads = fastq.read_pairs(spark, a.first, a.second)
    else:
        reads = fastq.read_fastq(spark, a.first)
    if phred_check(reads, p) < 0:
        print(f"qualities look more like Phred+{97 - p.phred_in} than Phred+{p.phred_in}", file=sys.stderr)
    if a.module == "filterStLFR":
        run, stats = filter_barcoded(reads, fastq.read_barcodes(spark, p.extra["barcodeListPath"]), p)
        write_report(stats, f"{a.folder}/report_barcodes")
    else:
        run = filter_reads(reads, p)
    write_run(run, a.folder, trimmed=a.trimmed, copies=p.rmdup, draw=a.plots)


if __name__ == "__main__":
    main()
