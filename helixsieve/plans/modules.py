"""The five modules: from reads and parameters to clean reads, discarded reads and reports. All frames are lazy."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from helixsieve.operators import alignments, barcodes, reports, selection
from helixsieve.operators.cascade import clean, discarded, judge, with_duplicates
from helixsieve.params import QCParams


@dataclass(frozen=True)
class Run:
    """What a run gives. judged has every read with its cuts and reason."""

    params: QCParams
    judged: DataFrame

    @property
    def clean(self) -> DataFrame:
        """Clean reads after the choice of head or sample, with a column ``split`` if parts were asked for."""
        p, out = self.params, clean(self.judged)
        if p.head_reads is not None:
            return selection.head(out, p.head_reads)
        if p.sample_reads is not None:
            return selection.sample(out, p.sample_reads)
        return selection.split(out, p.split_reads) if p.split_reads else out

    @property
    def discarded(self) -> DataFrame:
        return discarded(self.judged)

    @property
    def trimmed(self) -> DataFrame:
        """All reads after trimming, before any discard."""
        return self.judged

    @property
    def duplicates(self) -> DataFrame:
        return self.judged.where("dup") if "dup" in self.judged.columns else self.judged.limit(0)

    def histograms(self) -> DataFrame:
        """What four of the reports are made from: a cell a stage, mate, position and symbol."""
        return reports.histograms(self.judged, self.params, reports.STAGES)

    def reports(self, hist: DataFrame | None = None) -> dict[str, DataFrame]:
        """The reports by name; hist is :meth:`histograms`, if it is held already."""
        p, hist = self.params, self.histograms() if hist is None else hist
        shown = hist.where("stage != 'trim'")
        return {
            "general": reports.general_stats(hist, p.phred_in), "filter": reports.filter_report(self.judged),
            "base": reports.base_by_position(shown), "quality": reports.quality_by_position(shown, p.phred_in),
            "good": reports.good_by_position(shown, p.phred_in), "trim": reports.trim_positions(self.judged, p),
        }


def filter_reads(reads: DataFrame, p: QCParams) -> Run:
    """Modules filter, filterMeta and filtersRNA."""
    return Run(p, judge(reads, p))


def filter_barcoded(reads: DataFrame, barcode_list: DataFrame, p: QCParams) -> tuple[Run, DataFrame]:
    """Module filterStLFR, and its barcode report. Copies are found on uncut reads, and dropped before barcodes count."""
    p = replace(p, module="filterStLFR")
    if p.rmdup:
        reads = with_duplicates(reads, p)
    coded = barcodes.with_barcodes(reads, barcode_list, p)
    counted = coded.where("not dup") if p.rmdup else coded
    return Run(p, judge(coded, p)), barcodes.barcode_stats(counted, barcode_list.count(), len(p.barcode_regions))


def filter_alignments(records: DataFrame, p: QCParams) -> tuple[DataFrame, DataFrame]:
    """Module filterHts: marked records, and names that couldn't be judged."""
    return alignments.mark(records, p)
