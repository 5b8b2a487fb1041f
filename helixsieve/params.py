"""Parameters of a run: defaults, config file, validation."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field, fields, replace

MODULES = ("filter", "filterMeta", "filtersRNA", "filterStLFR", "filterHts")


@dataclass(frozen=True)
class Approx:
    """Limits of approximate adapter matching for one mate."""

    mismatches: int = 2
    match_ratio: float = 0.5
    edge: int = 6


@dataclass(frozen=True)
class QCParams:
    """All settings of a quality-control run. None switches a test off."""

    module: str = "filter"
    paired: bool = True
    # adapters and contaminants; several of each are tried in order
    adapters1: tuple[str, ...] = ()
    adapters2: tuple[str, ...] = ()
    approx1: Approx = Approx()
    approx2: Approx = Approx()
    adapter_mode: str = "discard"  # or "trim"
    contams1: tuple[str, ...] = ()
    contams2: tuple[str, ...] = ()
    contam_ratios: tuple[float, ...] = (0.2,)
    contam_mode: str = "discard"  # "trim" only turns the discard off
    global_contams: tuple[str, ...] = ()
    global_ratios: tuple[float, ...] = ()
    global_mismatches: tuple[int, ...] = ()
    # small RNA: the 3' adapter is adapters2[0], the 5' adapter adapters1[0]
    srna_min_aligned: int = 5
    srna_max_error: float = 0.4
    srna_max_mismatch: int = 4
    srna_run: int = 6
    srna_align_ratio: float = 0.8
    # discards
    rmdup: bool = False
    tiles: str | None = None
    fovs: str | None = None
    min_length: int | None = 30
    max_length: int | None = None
    max_n: float | None = 0.05
    max_a: float | None = None
    poly_x: int | None = None
    low_quality: int = 5
    max_low_quality: float | None = 0.5
    min_mean_quality: int | None = None
    overlap: int | None = None
    overlap_mismatch: float = 0.1
    # trims
    hard_trim: tuple[int, ...] | None = None  # head1, tail1[, head2, tail2]
    trim_bad_head: tuple[int, int] | None = None  # threshold, most bases
    trim_bad_tail: tuple[int, int] | None = None
    poly_g: int | None = None
    remove_index: bool = False
    # ids, qualities, output
    seq_type: int = 0
    phred_in: int = 33
    phred_out: int = 33
    max_quality: int = 42
    base_convert: tuple[str, str] | None = None
    mate_suffix: bool = False
    head_reads: int | None = None
    sample_reads: float | None = None  # a count, or below 1 a ratio
    split_reads: int | None = None
    fasta: bool = False
    # barcodes
    barcode_regions: tuple[tuple[int, int], ...] = ((101, 10), (117, 10), (133, 10))
    cut_without_barcode: bool = True
    ten_x: bool = False
    extra: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.check()

    def check(self) -> None:
        """Raise ValueError on settings that contradict each other."""
        wrong = []
        if self.module not in MODULES:
            wrong.append(f"module {self.module}")
        for name in ("adapters1", "adapters2", "contams1", "contams2", "global_contams"):
            wrong += [f"{name}: {x} has other letters than ACGTN" for x in getattr(self, name) if not re.fullmatch("[ACGTN]+", x)]
        if self.adapter_mode not in ("discard", "trim") or self.contam_mode not in ("discard", "trim"):
            wrong.append("modes are discard or trim")
        if self.adapters2 and not self.paired and self.module != "filtersRNA":
            wrong.append("a second adapter needs paired reads or small RNA")
        if self.module == "filterStLFR" and not self.paired:
            wrong.append("barcoded libraries are paired")
        if self.module == "filtersRNA" and self.paired:
            wrong.append("small RNA is single-end")
        if not len(self.global_contams) == len(self.global_ratios) == len(self.global_mismatches):
            wrong.append("global contaminants need a ratio and a mismatch number each")
        if len(self.contam_ratios) not in (1, len(self.contams1)):
            wrong.append("contaminants need one ratio, or one each")
        if self.head_reads is not None and self.sample_reads is not None:
            wrong.append("head and sample exclude each other")
        if self.split_reads is not None and (self.head_reads is not None or self.sample_reads is not None):
            wrong.append("split excludes head and sample")
        if self.phred_in not in (33, 64) or self.phred_out not in (33, 64):
            wrong.append("quality systems are 33 and 64")
        if self.seq_type not in (0, 1):
            wrong.append("seq_type is 0 or 1")
        if self.fovs and self.seq_type == 1:
            wrong.append("fov needs ids of seq_type 0")
        if self.hard_trim is not None and len(self.hard_trim) != (4 if self.paired else 2):
            wrong.append("trim takes two values a mate")
        if self.module == "filterHts" and (self.adapter_mode == "trim" or self.hard_trim or self.trim_bad_head or self.trim_bad_tail):
            wrong.append("alignment files are marked, not trimmed")
        if wrong:
            raise ValueError("; ".join(wrong))

    @staticmethod
    def srna(**own) -> QCParams:
        """Small RNA: single-end, 18 to 49 bases."""
        return QCParams(**({"module": "filtersRNA", "paired": False, "min_length": 18, "max_length": 49} | own))

    def mates(self) -> tuple[int, ...]:
        return (1, 2) if self.paired else (1,)

    @staticmethod
    def from_config(text: str, **own) -> QCParams:
        """Parse a config file: key=value or a bare key a line, # begins a comment."""
        return replace(QCParams(**own), **parse_config(text))


def _list(text: str, kind=str) -> tuple:
    return tuple(kind(x) for x in text.split(",") if x != "")


def parse_base_convert(text: str) -> tuple[str, str]:
    """X2Y or XtoY, any case, T and U among the letters."""
    m = re.fullmatch(r"([ACGTUN])(?:2|to)([ACGTUN])", text, re.IGNORECASE)
    if not m:
        raise ValueError(f"baseConvert {text}")
    return m[1].upper(), m[2].upper()


def _pairs(text: str) -> tuple[tuple[int, int], ...]:
    return tuple((int(a), int(b)) for a, b in (x.split("_") for x in text.split(",")))


def parse_config(text: str) -> dict:
    """Fields of QCParams from a config file's text. Keys about threads and files go to ``extra``."""
    out: dict = {}
    extra: dict[str, str] = {}
    approx: dict[str, list[str]] = {}
    off = lambda kind: lambda v: None if kind(v) == -1 else kind(v)
    simple = {
        "contam1": ("contams1", _list), "contam2": ("contams2", _list), "ctMatchR": ("contam_ratios", lambda v: _list(v, float)),
        "global_contams": ("global_contams", _list), "glob_cotm_mR": ("global_ratios", lambda v: _list(v, float)), "glob_cotm_mM": ("global_mismatches", lambda v: _list(v, int)),
        "tile": ("tiles", str), "fov": ("fovs", str), "seqType": ("seq_type", int), "maxReadLen": ("max_length", off(int)), "maxBaseQuality": ("max_quality", int),
        "overlap": ("overlap", off(int)), "mis": ("overlap_mismatch", float), "baseConvert": ("base_convert", parse_base_convert),
        "trim": ("hard_trim", lambda v: _list(v, int)), "trimBadHead": ("trim_bad_head", lambda v: _list(v, int)), "trimBadTail": ("trim_bad_tail", lambda v: _list(v, int)),
        "cleanOutSplit": ("split_reads", int), "barcodeRegionStr": ("barcode_regions", _pairs), "adaRCtg": ("srna_run", int), "adaRAr": ("srna_align_ratio", float),
        "adaRMa": ("srna_min_aligned", int), "adaREr": ("srna_max_error", float), "adaRMm": ("srna_max_mismatch", int),
        "qualSys": ("phred_in", lambda v: {"1": 64, "2": 33}.get(v, None) or int(v)), "outQualSys": ("phred_out", lambda v: {"1": 64, "2": 33}.get(v, None) or int(v)),
    }
    flags = {"contam_trim": ("contam_mode", "trim"), "index": ("remove_index", True), "pe_info": ("mate_suffix", True), "rmdup": ("rmdup", True), "notCutNoLFR": ("cut_without_barcode", False), "tenX": ("ten_x", True)}
    files = {"trimFq1", "trimFq2", "patch", "log", "barcodeListPath", "inputAsList"}
    for raw in text.splitlines():
        line = raw.split("#", 1)[0].strip()
        if not line:
            continue
        key, _, value = (x.strip() for x in line.partition("="))
        if key in simple:
            out[simple[key][0]] = simple[key][1](value)
        elif key in flags:
            out[flags[key][0]] = flags[key][1]
        elif key in ("adaMis", "adaMR", "adaEdge"):
            approx[key] = value.split(",")
        elif key == "totalReadsNum":
            if value.endswith("head"):
                out["head_reads"] = int(value.removesuffix("head"))
            else:
                out["sample_reads"] = float(value)
        elif key == "outFileType":
            out["fasta"] = value.lower() == "fasta"
        elif key in files:
            extra[key] = value or "true"
        else:
            raise ValueError(f"unknown config key {key}")
    if approx:
        pick = lambda k, i, kind, d: kind(approx[k][min(i, len(approx[k]) - 1)]) if k in approx else d
        for i in (0, 1):
            d = Approx()
            out[f"approx{i + 1}"] = Approx(pick("adaMis", i, int, d.mismatches), pick("adaMR", i, float, d.match_ratio), pick("adaEdge", i, int, d.edge))
    if extra:
        out["extra"] = extra
    return out


def read_adapters(values: Iterable[str], open_text=None) -> tuple[str, ...]:
    """Adapters from literals and from list files (one a line); open_text gives a file's text, or None if it's no file."""
    out: list[str] = []
    for v in values:
        text = open_text(v) if open_text else None
        out += [v] if text is None else [x.strip() for x in text.splitlines() if x.strip()]
    return tuple(out)


def field_names() -> list[str]:
    return [f.name for f in fields(QCParams)]
