"""Approximate matching of adapters and contaminants, vectorised over Arrow batches of reads.

An alignment lays a piece of the pattern over a piece of the read. It hits if, before its mismatches exceed what is
allowed, a run of matches reaches a threshold, or if all of it stays within the allowance. With cumulative counts that
is: some column whose mismatches so far are allowed has a run of the threshold, or the last column's mismatches are
allowed. An operator is a list of alignments in order, and its result the first hit's place.

Reads of a batch with one length are a matrix; an alignment is evaluated for all of them at once, and reads that have
hit leave. Where a pattern or read is too short for an alignment, the alignment is left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from helixsieve.functions.arrow import flat
from helixsieve.params import QCParams

N = ord("N")
#: One alignment: read columns from, pattern columns from, length, mismatches allowed, run that suffices, result.
Alignment = tuple[int, int, int, int, int, int]


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), np.uint8)


def _hits(reads: np.ndarray, pattern: np.ndarray, allowed: int, run: int, neutral_n: bool) -> np.ndarray:
    same = reads == pattern
    differ = ~same & (reads != N) if neutral_n else ~same
    wrong = np.cumsum(differ, axis=1, dtype=np.int16)
    right = np.cumsum(same, axis=1, dtype=np.int16)
    since = right - np.maximum.accumulate(np.where(differ, right, 0), axis=1)
    return ((since >= run) & same & (wrong <= allowed)).any(1) | (wrong[:, -1] <= allowed)


def first_hit(reads: np.ndarray, pattern: str, plan: Sequence[Alignment], neutral_n: bool) -> np.ndarray:
    """For equally long reads (rows of bytes) the result of the first alignment that hits, or -1."""
    out, own = np.full(len(reads), -1, np.int32), _bytes(pattern)
    columns, open_ = np.ascontiguousarray(reads.T), np.ones(len(reads), bool)
    free = columns == N if neutral_n else None
    for at, start, length, allowed, run, result in plan:
        # Sifts out most reads: a hit has a run of matches, or few mismatches, among its first columns.
        head = min(length, 8 + allowed)
        same = columns[at : at + head] == own[start : start + head, None]
        if neutral_n:
            same |= free[at : at + head]
        some = np.flatnonzero(open_ & (np.add.reduce(same, axis=0, dtype=np.uint16) >= min(head - allowed, run)))
        if not len(some):
            continue
        hit = some[_hits(reads[some, at : at + length], own[start : start + length], allowed, run, neutral_n)]
        out[hit] = result
        open_[hit] = False
        if not open_.any():
            break
    return out


def adapter_plan(read: int, pattern: int, mismatches: int, ratio: float, edge: int) -> list[Alignment]:
    """Adapter: up to five bases missing at the read's head, whole at each offset, cut off at the tail."""
    missing = 5
    run = math.ceil(np.float32(pattern) * np.float32(ratio))
    grad5 = max(1, (pattern - missing) // (mismatches + 1))
    grad = max(1, (pattern - edge) // (mismatches + 1))
    plan: list[Alignment] = [(0, r, pattern - r, (pattern - r) // grad5, run, 0) for r in range(1, missing + 1) if 0 < pattern - r <= read]
    plan += [(at, 0, pattern, mismatches, run, at) for at in range(read - pattern + 1)]
    plan += [(read - n, 0, n, (n - edge) // grad, run, read - n) for n in range(edge, pattern) if 0 < n <= read]
    return plan


def contaminant_plan(read: int, pattern: int, mismatches: int, ratio: float, edge: int) -> list[Alignment]:
    """Contaminant: its end at the read's head, whole at each offset, its beginning at the tail."""
    run = math.ceil(np.float32(pattern) * np.float32(ratio))
    grad = max(1, (pattern - edge) // (mismatches + 1))
    steps = run - 6
    run_grad = int((pattern - edge) / steps) if steps else 0
    part = lambda n: int(7 + (n - edge) / run_grad) if run_grad else 7
    short = [n for n in range(edge, pattern) if 0 < n <= read]
    plan: list[Alignment] = [(0, pattern - n, n, (n - edge) // grad, part(n), 0) for n in short]
    plan += [(at, 0, pattern, mismatches, run, at) for at in range(read - pattern + 1)]
    plan += [(read - n, 0, n, (n - edge) // grad, part(n), read - n) for n in short]
    return plan


def adapter_position(reads: np.ndarray, adapters: Sequence[str], mismatches: int, ratio: float, edge: int) -> np.ndarray:
    """The first adapter of the list that hits gives the place."""
    out = np.full(len(reads), -1, np.int32)
    for a in adapters:
        left = np.flatnonzero(out < 0)
        if len(left) and a:
            out[left] = first_hit(reads[left], a, adapter_plan(reads.shape[1], len(a), mismatches, ratio, edge), False)
    return out


def contaminant_position(reads: np.ndarray, contams: Sequence[str], ratios: Sequence[float], mismatches: int, edge: int, min_length: int | None) -> np.ndarray:
    """The smallest place of all hits; a list is left at a place below the least read length."""
    out, going = np.full(len(reads), -1, np.int32), np.ones(len(reads), bool)
    for i, c in enumerate(contams):
        left = np.flatnonzero(going)
        if not len(left) or not c:
            continue
        got = first_hit(reads[left], c, contaminant_plan(reads.shape[1], len(c), mismatches, ratios[i if len(ratios) > 1 else 0], edge), True)
        better = (got >= 0) & ((out[left] < 0) | (got < out[left]))
        out[left[better]] = got[better]
        if min_length is not None:
            going[left[(got >= 0) & (got < min_length)]] = False
    return out


#: A scan for a global contaminant begins as if so many mismatches had been seen: a fixed value of the behaviour.
SEEN = 5


class _Extents:
    """What each read of a matrix has of the contaminant while its columns are laid out one after another.

    An extent begins at an equal column and takes every column after it, equal or not. It ends with one mismatch more
    than allowed, or with as many as allowed and nothing equal yet, but not with the offset at which it began.
    """

    def __init__(self, n: int, allowed: int):
        self.allowed = allowed
        self.right, self.long = np.zeros(n, np.int32), np.zeros(n, np.int32)
        self.wrong = np.full(n, SEEN, np.int32)

    def inside(self) -> np.ndarray:
        return (self.wrong < self.allowed) | ((self.wrong == self.allowed) & (self.right > 0))

    def take(self, rows: np.ndarray, same: np.ndarray) -> None:
        self.right[rows & same] += 1
        self.wrong[rows & ~same] += 1
        self.long[rows] += 1

    def begin(self, rows: np.ndarray) -> None:
        self.right[rows], self.long[rows], self.wrong[rows] = 1, 1, 0

    def reaches(self, least: int) -> np.ndarray:
        """Whether an extent has ``least`` columns, of which all but the allowed ones are equal."""
        return (self.long >= least) & ((self.wrong < self.allowed) | ((self.wrong == self.allowed) & (self.right >= least - self.allowed)))

    def only(self, rows: np.ndarray) -> None:
        self.right, self.long, self.wrong = self.right[rows], self.long[rows], self.wrong[rows]


def _near(reads: np.ndarray, own: np.ndarray, least: int, allowed: int) -> Callable[[int, int, int, int], np.ndarray] | None:
    """A sift of reads for an offset: those with ``least`` columns, or as many but one at its beginning, all but ``allowed`` equal.

    Any ``least`` - 1 consecutive columns hold a whole block of ``least`` // 2 columns of the contaminant, so blocks are
    compared once at each place of the reads, for all offsets. None if blocks say nothing.
    """
    size, block = reads.shape[1], least // 2
    if block <= allowed:
        return None
    columns, near = np.ascontiguousarray(reads.T), {}
    for p in range(0, len(own) - block + 1, block):
        for r in range(size - block + 1):
            same = columns[r] == own[p]
            equal = same.view(np.uint8).copy() if block < 256 else same.astype(np.int32)
            for j in range(1, block):
                equal += columns[r + j] == own[p + j]
            rows = np.flatnonzero(equal >= block - allowed)
            if len(rows):
                near[p, r] = rows

    def rows_of(at: int, skip: int, length: int, most: int) -> np.ndarray:
        parts = [near[p, at + p - skip] for p in range(-(-skip // block) * block, skip + length - block + 1, block) if (p, at + p - skip) in near]
        if not parts:
            return np.zeros(0, np.int64)
        rows = np.unique(np.concatenate(parts))
        wrong = np.zeros((len(rows), length + 1), np.int32)
        np.cumsum(reads[rows, at : at + length] != own[skip : skip + length], axis=1, out=wrong[:, 1:])
        fits = wrong[:, min(length, most)] <= allowed
        if length >= least:
            fits |= (wrong[:, least:] - wrong[:, : length - least + 1] <= allowed).any(1)
        return rows[fits]

    return rows_of


def global_position(reads: np.ndarray, contam: str, ratio: float, allowed: int, *, sift: bool = True) -> np.ndarray:
    """Place of a global contaminant in each read: its end at the head (0), whole in the middle, its beginning at the tail.

    The three are sought in this order, each over its offsets in order. A hit is an extent of ``least`` columns. Between
    extents an offset is left once fewer than ``least`` of its columns remain; at the tail an equal column there still
    begins an extent, which goes on at the next offset. So what an offset finds depends on those before it.

    Of head and middle no extent goes on at the next offset, so an offset is laid out for those reads alone that may hit
    there. At the tail one of one column may, so an offset hits only if ``least`` columns of it, or its first ``least`` - 1,
    have no more mismatches than allowed; reads without such an offset are left out. Without ``sift`` none is.
    """
    n, size = reads.shape
    own, out, todo = _bytes(contam), np.full(n, -1, np.int32), np.arange(n)
    least = int(np.float32(len(own)) * np.float32(ratio))
    head = [(0, skip, min(size, len(own) - skip)) for skip in range(len(own) - least, -1, -1)]
    whole = [(at, 0, len(own)) for at in range(size - len(own) + 1)]
    tail = [(at, 0, size - at) for at in range(max(0, size - len(own)), size - least + 1)]
    near = _near(reads, own, least, allowed) if sift and 0 <= allowed <= SEEN else None
    parts = [(part, [offset]) for part in (head, whole) for offset in part] + [(tail, tail)] if near else [(part, part) for part in (head, whole, tail)]
    for part, offsets in parts:
        if near:
            rows = np.unique(np.concatenate([near(*o, least - 1) for o in offsets])) if offsets else np.zeros(0, np.int64)
            todo = rows[out[rows] == -1]
            if not len(todo):
                continue
        found = _Extents(len(todo), allowed)
        for at, skip, length in offsets:
            same = reads[todo, at : at + length] == own[skip : skip + length]
            here = np.ones(len(todo), bool)  # reads that haven't left this offset
            hit = np.full(len(todo), -1, np.int32)
            for j in range(length):
                few = length - j < least
                inside, equal = found.inside() & here, same[:, j]
                new = here & ~inside & equal if part is tail or not few else np.zeros(len(todo), bool)
                found.take(inside, equal)
                found.begin(new)
                done = (inside | new) & found.reaches(least)
                hit[done] = 0 if part is head else at + j - found.long[done] + 1
                here &= ~done & (inside if few else True)
                if not here.any():
                    break
            if (hit >= 0).any() or (hit < -1).any():
                out[todo[hit != -1]] = hit[hit != -1]
                found.only(hit == -1)
                todo = todo[hit == -1]
            if not len(todo):
                break
        if not near and not len(todo):
            return out
    return out


_COMPLEMENT = str.maketrans("ACGTacgt", "TGCATGCA")


def reverse_complement(seq: str) -> str:
    return seq.translate(_COMPLEMENT).upper()[::-1]


#: Complements of byte codes, lower-case letters as upper-case ones.
_COMPLEMENT_BYTES = np.frombuffer(reverse_complement("".join(map(chr, range(128)))[::-1]).encode(), np.uint8)


def global_positions(reads: np.ndarray, contams: Sequence[str], ratios: Sequence[float], allowed: Sequence[int], min_length: int | None) -> tuple[np.ndarray, np.ndarray]:
    """5' and 3' places of each read; at most one of a read is set."""

    def least(rows: np.ndarray) -> np.ndarray:
        out, going = np.full(len(rows), -1, np.int32), np.arange(len(rows))
        for c, r, m in zip(contams, ratios, allowed, strict=True):
            both = np.stack([global_position(rows[going], x, r, m) for x in (c, reverse_complement(c))])
            got = np.where(both < 0, both.max(0), both).min(0)
            better = (got >= 0) & ((out[going] < 0) | (got < out[going]))
            out[going[better]] = got[better]
            if min_length is not None:
                going = going[(got < 0) | (got >= min_length)]
        return out

    five, three = least(reads), np.full(len(reads), -1, np.int32)
    ask = (five >= 0) & (five <= reads.shape[1] // 2)
    if ask.any():
        three[ask] = least(_COMPLEMENT_BYTES[reads[ask]][:, ::-1])
    both = (five >= 0) & (three >= 0)
    return np.where(both & (five < three), -1, five), np.where(both & (five >= three), -1, three)


def srna_three_prime(reads: np.ndarray, adapter: str, aligned: int, error: float, mismatches: int) -> np.ndarray:
    """Place of a small-RNA 3' adapter: the best offset; of equals the later. An N of the read counts for neither."""
    n, read = reads.shape
    own, out = _bytes(adapter), np.full(n, -1, np.int32)
    best_wrong, best_right = np.zeros(n, np.int32), np.zeros(n, np.int32)
    offsets = [(0, 2), (0, 1)] + [(at, 0) for at in range(read - aligned + 1)] if len(own) else []
    for at, skip in offsets:
        length = min(len(own) - skip, read - at)
        if length <= 0 or at > read - aligned:
            continue
        part, pattern = reads[:, at : at + length], own[skip : skip + length]
        same, free = part == pattern, part == N
        right, wrong = (same & ~free).sum(1), (~same & ~free).sum(1)
        rate = (wrong / np.maximum(right, 1)).astype(np.float32)
        fits = (wrong <= mismatches) & (right + wrong >= aligned) & (right > 0) & (rate <= np.float32(error))
        better = fits & ((out < 0) | ((wrong <= best_wrong) & (right >= best_right)))
        out[better], best_wrong[better], best_right[better] = at, wrong[better], right[better]
    return out


def srna_five_prime(reads: np.ndarray, adapter: str, run: int, ratio: float) -> np.ndarray:
    """Whether a small-RNA 5' adapter occurs: suffixes of it at the read's head, then the whole along the read."""
    n, read = reads.shape
    own, out = _bytes(adapter), np.zeros(n, bool)
    if not len(own):
        return out
    offsets = [(0, skip) for skip in range(max(0, len(own) - run), 0, -1)] + [(at, 0) for at in range(max(0, read - run) + 1)]
    for at, skip in offsets:
        length = min(len(own) - skip, read - at)
        if length <= 0:
            continue
        same = reads[:, at : at + length] == own[skip : skip + length]
        right = np.cumsum(same, axis=1, dtype=np.int16)
        longest = (right - np.maximum.accumulate(np.where(same, 0, right), axis=1)).max(1)
        total = right[:, -1]
        out |= (length - total <= 4) & ((longest >= run) | (read < 12)) & ((total / read >= ratio) | (total / len(own) >= ratio))
    return out


def overlap_length(one: np.ndarray, two: np.ndarray, least: int, mismatch: float) -> np.ndarray:
    """For each pair the longest L such that the last L bases of read 1 are the first L of read 2's reverse complement, or
    -1. N never matches."""
    b = _COMPLEMENT_BYTES[two][:, ::-1]
    out, todo = np.full(len(one), -1, np.int32), np.arange(len(one))
    for n in range(min(one.shape[1], b.shape[1]), least - 1, -1):
        x, y = one[todo, one.shape[1] - n :], b[todo, :n]
        fits = ((x != y) | (x == N)).sum(1) <= int(mismatch * n)
        out[todo[fits]] = n
        todo = todo[~fits]
    return out


def _matrices(*columns: pa.Array) -> Iterator[tuple]:
    """Rows of one length (of each column), and their reads as matrices; null and empty reads are left out."""
    data = [flat(c) for c in columns]
    sizes = np.array([np.diff(edges) for _, edges in data])
    kinds, of = np.unique(sizes, axis=1, return_inverse=True)
    for k, size in enumerate(kinds.T.tolist()):
        if all(size):
            at = np.flatnonzero(of.ravel() == k)
            # Reads of one length lie as the matrix that they are; others are picked.
            yield at, *(x.reshape(-1, n) if len(kinds.T) == 1 else x[edges[at][:, None] + np.arange(n)] for (x, edges), n in zip(data, size, strict=True))


def by_length(seqs: pa.Array, own: Callable[[np.ndarray], np.ndarray], empty) -> np.ndarray:
    """Apply a function of equally long reads to reads of any length."""
    out = np.full(len(seqs), empty)
    for at, reads in _matrices(seqs):
        out[at] = own(reads)
    return out


def _udf(own: Callable[[np.ndarray], np.ndarray], empty, kind: str):
    to = pa.bool_() if kind == "boolean" else pa.int32()

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for seqs in batches:
            yield pa.array(by_length(seqs, own, empty), to)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind)


def adapter_position_of(seq: Column, p: QCParams, mate: int) -> Column:
    a, adapters = (p.approx1, p.adapters1) if mate == 1 else (p.approx2, p.adapters2)
    return _udf(lambda m: adapter_position(m, adapters, a.mismatches, a.match_ratio, a.edge), -1, "int")(seq)


def contaminant_position_of(seq: Column, p: QCParams, mate: int) -> Column:
    contams = p.contams1 if mate == 1 else p.contams2
    return _udf(lambda m: contaminant_position(m, contams, p.contam_ratios, p.approx1.mismatches, p.approx1.edge, p.min_length), -1, "int")(seq)


def global_positions_of(seq: Column, p: QCParams) -> Column:
    def run(seqs: pa.Array) -> pa.Array:
        five, three = np.full((2, len(seqs)), -1, np.int32)
        for at, reads in _matrices(seqs):
            five[at], three[at] = global_positions(reads, p.global_contams, p.global_ratios, p.global_mismatches, p.min_length)
        return pa.StructArray.from_arrays([pa.array(five), pa.array(three)], ["five", "three"])

    run.__annotations__ = {"seqs": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "five int, three int")(seq)


def srna_three_prime_of(seq: Column, p: QCParams) -> Column:
    adapter = p.adapters2[0] if p.adapters2 else ""
    return _udf(lambda m: srna_three_prime(m, adapter, p.srna_min_aligned, p.srna_max_error, p.srna_max_mismatch), -1, "int")(seq)


def srna_five_prime_of(seq: Column, p: QCParams) -> Column:
    adapter = p.adapters1[0] if p.adapters1 else ""
    return _udf(lambda m: srna_five_prime(m, adapter, p.srna_run, p.srna_align_ratio), False, "boolean")(seq)


def overlap_of(seq1: Column, seq2: Column, p: QCParams) -> Column:
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        out = np.full(len(a), -1, np.int32)
        for at, one, two in _matrices(a, b):
            out[at] = overlap_length(one, two, p.overlap or 0, p.overlap_mismatch)
        return pa.array(out)

    run.__annotations__ = {"a": pa.Array, "b": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "int")(seq1, seq2)
