"""Per-read features as built-in column expressions.

Ratios are 32-bit floats on both sides of every comparison: 0.05 as a float lies above 0.05 as a double, and a
threshold must not depend on that. Base counts ignore case; runs and matches don't.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _class(lo: int, hi: int) -> str:
    """A regular expression's class of the characters lo to hi."""
    return rf"[\x{{{lo:x}}}-\x{{{hi:x}}}]"


def count_base(seq: Column, base: str) -> Column:
    return F.length(seq) - F.length(F.translate(seq, base.upper() + base.lower(), ""))


def ratio(n: Column, of: Column) -> Column:
    """n / of as a 32-bit float; null for an empty read."""
    return F.try_divide(n.cast("float"), of.cast("float")).cast("float")


def longest_run(seq: Column) -> Column:
    """Longest run of one character, any, N included; 1 at least."""
    runs = F.regexp_extract_all(seq, F.lit(r"((.)\2*)"), F.lit(1))
    return F.greatest(F.lit(1), F.array_max(F.transform(runs, F.length)))


def has_run(seq: Column, n: int) -> Column:
    """Whether a run of n characters occurs; cheaper than its length."""
    return seq.rlike(rf"(.)\1{{{n - 1}}}") if n > 1 else F.length(seq) > 0


def count_up_to(qual: Column, q: int, phred: int) -> Column:
    """Qualities of at most q."""
    return F.length(qual) - F.length(F.regexp_replace(qual, _class(0, phred + q), ""))


def count_from(qual: Column, q: int, phred: int) -> Column:
    return F.length(qual) - count_up_to(qual, q - 1, phred)


def sum_quality(qual: Column, phred: int) -> Column:
    """Sum of qualities; bytes of the text are its characters, for qualities are ASCII."""
    return F.aggregate(F.split(qual, ""), F.lit(0), lambda a, c: a + F.when(c == "", 0).otherwise(F.ascii(c) - phred))


def tile(read_id: Column, seq_type: int = 0) -> Column:
    """Four digits behind the second colon (seq_type 0) or the fourth."""
    return F.regexp_extract(read_id, rf"^(?:[^:]*:){{{2 if seq_type == 0 else 4}}}(\d{{4}})", 1)


def fov(read_id: Column) -> Column:
    """Eight characters from the first C that has an R four behind it; empty if none is followed by more."""
    return F.substr(F.regexp_extract(read_id, "(C...R...).", 0), F.lit(1), F.lit(8))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(F.upper(seq), "ACGT", "TGCA"))


def tail_g(seq: Column) -> Column:
    """Length of the run of G or g at the end."""
    return F.length(F.regexp_extract(seq, "[Gg]*$", 0))


def bad_head(qual: Column, below: int, most: int, phred: int) -> Column:
    """Length of the run of qualities below a threshold at the head, of at most ``most``."""
    return F.length(F.regexp_extract(F.substr(qual, F.lit(1), F.lit(most)), "^" + _class(0, phred + below - 1) + "*", 0))


def bad_tail(qual: Column, below: int, most: int, phred: int) -> Column:
    return bad_head(F.reverse(qual), below, most, phred)


def rebase_quality(qual: Column, phred_in: int, phred_out: int) -> Column:
    if phred_in == phred_out:
        return qual
    n = 127 - max(phred_in, phred_out)
    return F.translate(qual, "".join(chr(phred_in + i) for i in range(n)), "".join(chr(phred_out + i) for i in range(n)))


def convert_base(seq: Column, base: str, to: str) -> Column:
    """Replace a base in either case by another in upper case."""
    return F.translate(seq, base.upper() + base.lower(), to.upper() * 2)


def remove_index(read_id: Column, seq_type: int = 0) -> Column:
    """seq_type 0: drop from # up to the next slash; 1: cut at the last colon."""
    return F.regexp_replace(read_id, "#[^/]*", "") if seq_type == 0 else F.regexp_replace(read_id, ":[^:]*$", "")


def valid(seq: Column) -> Column:
    return F.coalesce(seq.rlike("^[ACGTNacgtn]+$"), F.lit(False))


def parse_spec(spec: str) -> tuple[list[str], list[tuple[int, int]]]:
    """A tile or fov list: single entries, and inclusive ranges a-b of numbers."""
    single, ranges = [], []
    for part in (x.strip() for x in spec.split(",") if x.strip()):
        m = re.fullmatch(r"(\d+)-(\d+)", part)
        if m:
            ranges.append((int(m[1]), int(m[2])))
        else:
            single.append(part)
    return single, ranges


def in_spec(value: Column, spec: str) -> Column:
    """Whether a tile or fov is listed."""
    single, ranges = parse_spec(spec)
    out = value.isin(*single) if single else F.lit(False)
    number = F.when(value.rlike(r"^\d+$"), value.cast("int"))
    for a, b in ranges:
        out = out | F.coalesce(number.between(a, b), F.lit(False))
    return out


def scalar_features(seq: Column, qual: Column, *, low_quality: int = 5, phred: int = 33, runs: bool = False) -> Column:
    """A struct of counts; ratios derive from them where they are needed."""
    own = [F.length(seq).alias("len"), *(count_base(seq, b).alias(b.lower()) for b in "ACGTN")]
    own += [count_up_to(qual, low_quality, phred).alias("low"), count_from(qual, 20, phred).alias("q20"), count_from(qual, 30, phred).alias("q30"), sum_quality(qual, phred).alias("qsum")]
    return F.struct(*own, *([longest_run(seq).alias("run")] if runs else []))
