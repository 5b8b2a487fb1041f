"""Approximate matching against plain walks over every alignment."""

import math
import random

import numpy as np
import pytest

from helixsieve.functions import matching as M


def walk(read, pattern, allowed, run, neutral):
    """One alignment, column by column."""
    wrong = right = 0
    for r, p in zip(read, pattern, strict=True):
        if r == p:
            right += 1
            if right >= run:
                return True
        elif not (neutral and r == "N"):
            wrong, right = wrong + 1, 0
            if wrong > allowed:
                return False
    return wrong <= allowed


def slow_adapter(read, a, mis, ratio, edge):
    n, run = len(a), math.ceil(np.float32(len(a)) * np.float32(ratio))
    g5, g = max(1, (n - 5) // (mis + 1)), max(1, (n - edge) // (mis + 1))
    for r in range(1, 6):
        if 0 < n - r <= len(read) and walk(read[: n - r], a[r:], (n - r) // g5, run, False):
            return 0
    for at in range(len(read) - n + 1):
        if walk(read[at : at + n], a, mis, run, False):
            return at
    for k in range(edge, n):
        if k <= len(read) and walk(read[len(read) - k :], a[:k], (k - edge) // g, run, False):
            return len(read) - k
    return -1


def slow_contaminant(read, c, mis, ratio, edge):
    n, run = len(c), math.ceil(np.float32(len(c)) * np.float32(ratio))
    g = max(1, (n - edge) // (mis + 1))
    rg = int((n - edge) / (run - 6)) if run != 6 else 0
    need = lambda k: int(7 + (k - edge) / rg) if rg else 7
    for k in range(edge, n):
        if k <= len(read) and walk(read[:k], c[n - k :], (k - edge) // g, need(k), True):
            return 0
    for at in range(len(read) - n + 1):
        if walk(read[at : at + n], c, mis, run, True):
            return at
    for k in range(edge, n):
        if k <= len(read) and walk(read[len(read) - k :], c[:k], (k - edge) // g, need(k), True):
            return len(read) - k
    return -1


def reads(rng, patterns, n=60, size=40):
    """Reads with whole, cut and wrong copies of patterns."""
    out = []
    for _ in range(n):
        base = "".join(rng.choice("ACGT") for _ in range(size))
        p = rng.choice(patterns)
        at = rng.randint(-10, size)
        text = "".join(p[i - at] if 0 <= i - at < len(p) and rng.random() < 0.7 else b for i, b in enumerate(base)) if rng.random() < 0.5 else "".join(p[i - at] if 0 <= i - at < len(p) else b for i, b in enumerate(base))
        out.append("".join("N" if rng.random() < 0.03 else b for b in text))
    return out


def matrix(rows):
    return np.frombuffer("".join(rows).encode(), np.uint8).reshape(len(rows), -1)


@pytest.mark.parametrize("seed", range(6))
def test_adapter_and_contaminant(seed):
    rng = random.Random(seed)
    patterns = ["".join(rng.choice("ACGT") for _ in range(k)) for k in (9, 16, 20, 32)]
    rows = reads(rng, patterns, size=rng.choice([12, 30, 48]))
    for p in patterns:
        for mis, ratio, edge in ((2, 0.5, 6), (1, 0.8, 6), (0, 1.0, 8), (2, 0.2, 6)):
            assert M.adapter_position(matrix(rows), [p], mis, ratio, edge).tolist() == [slow_adapter(r, p, mis, ratio, edge) for r in rows]
            assert M.contaminant_position(matrix(rows), [p], [ratio], mis, edge, None).tolist() == [slow_contaminant(r, p, mis, ratio, edge) for r in rows]


def test_lists():
    row = matrix(["ACGTACGTAC" + "TTTTGGGGCCCCAAAA" + "GATTACAGAT"])
    a, b = "TTTTGGGGCCCCAAAA", "CCCCAAAAGATTACAG"
    assert M.adapter_position(row, [b, a], 0, 1.0, 16).tolist() == [18]
    assert M.contaminant_position(row, [b, a], [1.0], 0, 16, None).tolist() == [10]
    assert M.contaminant_position(row, [b, a], [1.0], 0, 16, 30).tolist() == [18]  # the list is left below the least length


def slow_three(read, a, aligned, error, most):
    best = None
    for at, skip in [(0, 2), (0, 1)] + [(i, 0) for i in range(len(read) - aligned + 1)]:
        if at > len(read) - aligned:
            continue
        cols = [(r, p) for r, p in zip(read[at:], a[skip:]) if r != "N"]
        right = sum(r == p for r, p in cols)
        wrong = len(cols) - right
        if right and wrong <= most and len(cols) >= aligned and np.float32(wrong / right) <= np.float32(error) and (best is None or (wrong <= best[1] and right >= best[2])):
            best = (at, wrong, right)
    return best[0] if best else -1


def slow_five(read, a, run, ratio):
    for at, skip in [(0, s) for s in range(len(a) - run, 0, -1)] + [(i, 0) for i in range(max(0, len(read) - run) + 1)]:
        cols = [r == p for r, p in zip(read[at:], a[skip:])]
        right = sum(cols)
        longest = max((len(x) for x in "".join("x" if c else " " for c in cols).split()), default=0)
        if len(cols) - right <= 4 and (longest >= run or len(read) < 12) and (right / len(read) >= ratio or right / len(a) >= ratio):
            return True
    return False


@pytest.mark.parametrize("seed", range(4))
def test_small_rna(seed):
    rng = random.Random(seed)
    a = "".join(rng.choice("ACGT") for _ in range(20))
    for size in (6, 11, 30):
        rows = reads(rng, [a], size=size)
        assert M.srna_three_prime(matrix(rows), a, 5, 0.4, 4).tolist() == [slow_three(r, a, 5, 0.4, 4) for r in rows]
        assert M.srna_five_prime(matrix(rows), a, 6, 0.8).tolist() == [slow_five(r, a, 6, 0.8) for r in rows]


def slow_global(read, c, ratio, allowed):
    """Extents of one read, as spans of a stream of columns: (place, kept equal, kept unequal)."""
    least = int(np.float32(len(c)) * np.float32(ratio))
    head = [(0, len(c) - k) for k in range(least, len(c) + 1)]
    whole = [(i, 0) for i in range(len(read) - len(c) + 1)]
    tail = [(len(read) - k, 0) for k in range(min(len(c), len(read)), least - 1, -1)]
    for part, offsets in (("head", head), ("whole", whole), ("tail", tail)):
        equal, unequal = 0, 5
        for at, skip in offsets:
            cols = [r == x for r, x in zip(read[at:], c[skip:])]
            for j, same in enumerate(cols):
                few = len(cols) - j < least
                leaves = False
                if unequal < allowed or (unequal == allowed and equal):
                    equal, unequal = equal + same, unequal + (not same)
                elif same and (part == "tail" or not few):
                    equal, unequal, leaves = 1, 0, few
                else:
                    if few:
                        break
                    continue
                if equal + unequal >= least and slow_reaches(equal, unequal, least, allowed):
                    return 0 if part == "head" else at + j - (equal + unequal) + 1
                if leaves:
                    break
    return -1


def slow_reaches(equal, unequal, least, allowed):
    return unequal < allowed or (unequal == allowed and equal >= least - allowed)


def test_global_contaminants():
    c = "ACGGTTCAGCATTGCA"
    pad = "T" * 30
    place = lambda read: M.global_position(matrix([read]), c, 0.5, 0).tolist()[0]
    assert place(pad + c + pad) == 30
    assert place(c[6:] + pad) == 0
    assert place(pad + c[:10]) in (29, 30)  # an extent goes on from the offset before
    assert place(pad) == -1
    five, three = M.global_positions(matrix([pad + M.reverse_complement(c) + pad * 2]), [c], [0.9], [0], None)
    assert (five.tolist(), three.tolist()) == ([-1], [60])  # the smaller place is dropped


@pytest.mark.parametrize("seed", range(4))
def test_global_contaminants_in_random_reads(seed):
    rng = random.Random(seed)
    patterns = ["".join(rng.choice("ACGT") for _ in range(k)) for k in (9, 16, 32)]
    rows = reads(rng, patterns, size=rng.choice([12, 30, 48]))
    for p in patterns:
        for ratio, allowed in ((0.5, 1), (0.8, 0), (0.4, 3)):
            assert M.global_position(matrix(rows), p, ratio, allowed).tolist() == [slow_global(r, p, ratio, allowed) for r in rows]


def test_overlap():
    insert = "ACGTTGCAAGCTTACGGATCCATTGCAAC"
    one, two = "GGGG" + insert, M.reverse_complement(insert + "TTTT")
    assert M.overlap_length(matrix([one]), matrix([two]), 20, 0.0).tolist() == [len(insert)]
    assert M.overlap_length(matrix(["A" * 30]), matrix(["A" * 30]), 20, 0.1).tolist() == [-1]


def test_global_contaminants_sift(monkeypatch):
    rng, letters = np.random.default_rng(7), np.frombuffer(b"ACGTN", np.uint8)
    for _ in range(150):
        kinds, long, size = rng.integers(2, 5), rng.integers(1, 40), rng.integers(1, 60)
        own, reads = letters[rng.integers(0, kinds, long)], letters[rng.integers(0, kinds, (40, size))]
        for row in reads:
            at, n = rng.integers(0, size), rng.integers(0, long + 1)
            row[at : at + n] = own[: len(row[at : at + n])]
            row[rng.integers(0, size)] = letters[rng.integers(0, 5)]
        args = reads, own.tobytes().decode(), float(rng.choice([0.1, 0.3, 0.5, 0.7, 1.0])), int(rng.integers(0, 8))
        assert (M.global_position(*args) == M.global_position(*args, sift=False)).all()
    laid = []
    monkeypatch.setattr(M, "_Extents", lambda n, allowed, own=M._Extents: laid.append(n) or own(n, allowed))
    M.global_position(letters[rng.integers(0, 4, (1000, 128))], "AGATCGGAAGAGCACACGTCTGAACTCCAGTC", 0.5, 1)
    assert sum(laid) < 100
