"""Removal of repeated passages by prefix-partitioned suffix trees over words.

Every word of a text begins a suffix, of which the first ``window`` words matter. Suffixes are dealt into groups by a
part of those words, the group's prefix, whose length varies: at first it is the smallest-hashed ``gram`` of the window,
so that neighbouring suffixes of a text mostly share a group and travel as one stretch of its words. A prefix that
occurs once has no partner, and is dropped by counting prefixes before any text moves. A prefix with more than
``group_rows`` stretches is lengthened: its suffixes are told apart by where the gram lies in them, in four ranges,
and those of a range have all but a fourth of the window's range in common; the longer part is their prefix. What is
still too large by then has nearly the whole window as its prefix, and is lengthened to all of it: such suffixes need
no tree, for each digest of a window is a leaf or a node already, and counting them gathers none in one place.

A group of fitting size meets in one task, as words. Its subtree is its sorted suffixes with the longest common
prefixes of neighbours; internal nodes of depth ``window`` or more are maximal runs of neighbours that share as much, and
their suffixes are the repeats. Words are compared as words, and whole windows by a 128-bit BLAKE2b digest of them.
Words under any repeat's window are removed.

A null text and one without words have no suffix, nor has a text shorter than the window. A text of any length is read
whole, and its suffixes are spread over groups. Repeated rows repeat all their windows; of ties none stays. Empty
tables give an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixsieve.llm.common import Scratch, small_batches, with_uid
from helixsieve.llm.words import U, grams, mix, word_hashes, word_spans

PLACE = U((1 << 20) - 1)
UID = "struct<f:long,r:long>"
#: Suffixes that a task sorts at a time, group by group.
SUFFIXES = 30_000
#: Ranges that the gram's place in a window is told apart by.
RANGES = 4


def anchors(words: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Grams that are the smallest of some window, the first of equal ones: hash, place, first and last window."""
    n = len(words) - window + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none, none
    g, width = grams(words, gram), window - gram + 1
    at = np.arange(n)
    if len(g) <= int(PLACE):  # hash and place in one number
        low = _slide((g & ~PLACE) | np.arange(len(g), dtype=np.uint64), width, np.minimum)[:n]
        place = (low & PLACE).astype(np.int64)
    else:
        high = g & ~PLACE
        place = _slide(np.arange(len(g)), width, lambda a, b: np.where(high[b] < high[a], b, a))[:n]
    first = np.flatnonzero(np.diff(place, prepend=-1))
    return g[place[first]], place[first], at[first], np.append(first[1:], n) - 1


def _slide(x: np.ndarray, width: int, least) -> np.ndarray:
    """The least of each width neighbours; of equal ones the first."""
    n, step = len(x) - width + 1, 1
    while 2 * step <= width:
        x, step = least(x[:-step], x[step:]), 2 * step
    return least(x[:n], x[width - step : width - step + n]) if step < width else x[:n]


def suffix_array(suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows of words, each a suffix cut at the depth that counts, and what each shares with the one before."""
    packed = np.ascontiguousarray(suffixes.astype(">u4")).view(f"S{4 * suffixes.shape[1]}")[:, 0]
    order = np.argsort(packed, kind="stable")
    ordered = suffixes[order]
    return order, np.concatenate([[0], np.logical_and.accumulate(ordered[1:] == ordered[:-1], axis=1).sum(1)])[: len(order)]


def deep_nodes(order: np.ndarray, shared: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix the node of at least that depth that it belongs to: neighbours that share as much."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(shared < depth)
    return out


def _anchor_rows(window: int, gram: int, full: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [anchors(word_hashes(t or b""), window, gram) for t in batch.column("data").to_pylist()]
            f = pa.array(np.concatenate([x[0] for x in got]).view(np.int64) if got else [], pa.int64())
            if not full:
                yield pa.RecordBatch.from_arrays([f], ["prefix"])
                continue
            rows = pa.array(np.repeat(np.arange(len(got)), [len(x[0]) for x in got]), pa.int64())
            place, first, last = (pa.array(np.concatenate([x[i] for x in got]) if got else [], pa.int32()) for i in (1, 2, 3))
            yield pa.RecordBatch.from_arrays([batch.column("uid").take(rows), f, place, first, last], ["uid", "prefix", "place", "first", "last"])

    return run


def _listed(batch: pa.RecordBatch, *names: str) -> Iterator[tuple[int, bytes, list[np.ndarray]]]:
    """Row, text and the named fields of the list ``places`` of each row, as arrays."""
    lists = batch.column("places")
    offsets, flat = lists.offsets.to_numpy(), lists.values
    fields = [flat.field(n).to_numpy(zero_copy_only=False) for n in names]
    for row, text in enumerate(batch.column("data").to_pylist()):
        yield row, text or b"", [f[offsets[row] : offsets[row + 1]] for f in fields]


def _longer(window: int, gram: int):
    """From a text and its places of frequent prefixes to stretches by longer ones: (uid, prefix, first, last)."""
    width = window - gram + 1
    step = -(-width // RANGES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(4)]
            for row, text, (place, first, last) in _listed(batch, "place", "first", "last"):
                own = word_hashes(text)
                for low in range(0, width, step):
                    high = min(low + step, width) - 1
                    a, b = np.maximum(first, place - high), np.minimum(last, place - low)
                    some = a <= b
                    common = mix(grams(own, window - (high - low))[(place - low)[some]] + U(low))
                    for out, x in zip(rows, (np.full(some.sum(), row), common.view(np.int64), a[some], b[some]), strict=True):
                        out.append(x)
            at, prefix, a, b = (np.concatenate(x) for x in rows)
            yield pa.RecordBatch.from_arrays([batch.column("uid").take(pa.array(at)), pa.array(prefix), pa.array(a, pa.int32()), pa.array(b, pa.int32())], ["uid", "prefix", "first", "last"])

    return run


def _windows(window: int):
    """From a text and its places to the digest of each of their windows: (digest, uid, start)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text, (first, last) in _listed(batch, "first", "last"):
                words = text.split()
                ends = np.cumsum([len(w) + 1 for w in words])
                begins, text = (ends - np.array([len(w) + 1 for w in words])).tolist(), b" ".join(words)
                starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last, strict=True)])
                stops = (ends[starts + window - 1] - 1).tolist()
                own = [hashlib.blake2b(text[begins[i] : e], digest_size=16).digest() for i, e in zip(starts.tolist(), stops, strict=True)]
                uid = batch.column("uid").take(pa.array(np.full(len(own), row)))
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), uid, pa.array(starts, pa.int32())], ["digest", "uid", "start"])

    return run


def _stretches(window: int):
    """From a text and its places to the words of each: (prefix, uid, first, last, words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text, (prefix, first, last) in _listed(batch, "prefix", "first", "last"):
                _, starts, ends = word_spans(text)
                own = [text[a:b] for a, b in zip(starts[first].tolist(), ends[last + window - 1].tolist(), strict=True)]
                uid = batch.column("uid").take(pa.array(np.full(len(own), row)))
                yield pa.RecordBatch.from_arrays([pa.array(prefix), uid, pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(own, pa.binary())], ["prefix", "uid", "first", "last", "words"])

    return run


def _subtrees(window: int):
    """From sorted stretches, group by group, to runs of repeated suffixes: (uid, start, stop)."""

    def solve(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        prefix, first, last = (table.column(c).to_numpy() for c in ("prefix", "first", "last"))
        text = pd.factorize(np.array(b" ".join(table.column("words").to_pylist()).split(), dtype=object))[0].astype(np.uint32)
        counts = (last - first + 1).astype(np.int64)
        sizes = counts + window - 1
        row = np.repeat(np.arange(len(counts)), counts)
        within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        group = np.cumsum(np.concatenate([[0], prefix[1:] != prefix[:-1]])).astype(np.uint32)
        own = np.lib.stride_tricks.sliding_window_view(text, window)[(np.cumsum(sizes) - sizes)[row] + within]
        node = deep_nodes(*suffix_array(np.concatenate([group[row][:, None], own], axis=1)), window + 1)
        many = np.bincount(node)[node] > 1
        # Runs of repeated suffixes that follow one another in a text.
        edge = np.flatnonzero(np.diff(np.where(many, row, -1), prepend=-1, append=-1))
        a, b = edge[:-1], edge[1:]
        keep = many[a] if len(a) else np.zeros(0, bool)
        a, b = a[keep], b[keep] - 1
        uid = table.column("uid").combine_chunks().take(pa.array(row[a]))
        return pa.RecordBatch.from_arrays([uid, pa.array(first[row[a]] + within[a], pa.int32()), pa.array(first[row[a]] + within[b], pa.int32())], ["uid", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole groups, about SUFFIXES at a time."""
        kept: list[pa.RecordBatch] = []
        size, before = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            prefix = batch.column("prefix").to_numpy()
            upto = np.concatenate([[0], np.cumsum(batch.column("last").to_numpy() - batch.column("first").to_numpy() + 1)])
            edges = np.concatenate([[0] if kept and before != prefix[0] else [], np.flatnonzero(prefix[1:] != prefix[:-1]) + 1]).astype(np.int64)
            begin = 0
            while (at := np.searchsorted(upto[edges], SUFFIXES - size + upto[begin])) < len(edges):
                end = int(edges[at])
                kept.append(batch.slice(begin, end - begin))
                yield solve([b for b in kept if b.num_rows])
                kept, size, begin, edges = [], 0, end, edges[at + 1 :]
            kept.append(batch.slice(begin))
            size, before = size + int(upto[-1] - upto[begin]), prefix[-1]
        if kept:
            yield solve(kept)

    return run


def _by_text(places: DataFrame, docs: DataFrame, *names: str) -> DataFrame:
    """Texts that have places, with the list of them; the join is a merge at every size."""
    return places.groupBy("uid").agg(F.collect_list(F.struct(*names)).alias("places")).hint("merge").join(docs.select("uid", "data"), "uid")


def _counted(places: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """places of prefixes that occur more than once, with n, how often."""
    counts = scratch.save(places.groupBy("prefix").agg(F.count("*").alias("n")).where("n > 1"), f"{name}-counts")
    return scratch.save(places.hint("merge").join(counts, "prefix"), name)


def repeated_runs(docs: DataFrame, *, window: int, gram: int, group_rows: int, scratch: Scratch) -> DataFrame:
    """(uid, start, stop, alone): runs of window starts whose windows also start elsewhere, but for those of rows that
    say ``alone``. docs has uid and data."""
    prefixes = docs.select("data").mapInArrow(_anchor_rows(window, gram, False), "prefix long")
    prefixes = scratch.save(prefixes.groupBy("prefix").agg(F.count("*").alias("n")).where("n > 1"), "prefixes")
    places = docs.select("uid", "data").mapInArrow(_anchor_rows(window, gram, True), f"uid {UID}, prefix long, place int, first int, last int")
    places = scratch.save(places.hint("merge").join(prefixes, "prefix"), "places")
    fits = F.col("n") <= group_rows
    small, runs = places.where(fits).select("uid", "prefix", "first", "last"), []
    if not places.where(~fits).isEmpty():
        longer = _by_text(places.where(~fits), docs, "place", "first", "last").mapInArrow(_longer(window, gram), f"uid {UID}, prefix long, first int, last int")
        longer = _counted(scratch.save(longer, "longer"), scratch, "longer-places")
        small = small.unionByName(longer.where(fits).select("uid", "prefix", "first", "last"))
        whole = _by_text(longer.where(~fits), docs, "first", "last").mapInArrow(_windows(window), f"digest binary, uid {UID}, start int")
        # Of frequent windows few stand alone; counts meet by digest, after the parts of each task.
        alone = whole.groupBy("digest").agg(F.count("*").alias("n"), F.first("uid").alias("uid"), F.first("start").alias("start")).where("n = 1")
        alone = scratch.save(alone.select("uid", "start", F.col("start").alias("stop"), F.lit(True).alias("alone")), "alone")
        runs = [longer.where(~fits).select("uid", F.col("first").alias("start"), F.col("last").alias("stop"), F.lit(False).alias("alone")), alone]
    rows = _by_text(small, docs, "prefix", "first", "last").mapInArrow(_stretches(window), f"prefix long, uid {UID}, first int, last int, words binary")
    rows = rows.repartition("prefix").sortWithinPartitions("prefix")
    out = scratch.save(rows.mapInArrow(_subtrees(window), f"uid {UID}, start int, stop int"), "nodes").withColumn("alone", F.lit(False))
    for more in runs:
        out = out.unionByName(more)
    return out


def _remove(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, gone, shas, texts = [], [], [], []
            for data, runs in zip(batch.column("data").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                words = (data or b"").split()
                n = len(words)
                if runs:
                    starts, edge = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
                    at = np.array([(r["start"], r["stop"] + 1) for r in runs if not r["alone"]], np.int64).reshape(-1, 2)
                    np.add.at(starts, at[:, 0], 1)
                    np.add.at(starts, at[:, 1], -1)
                    starts = np.cumsum(starts) > 0
                    starts[[r["start"] for r in runs if r["alone"]]] = False
                    np.add.at(edge, np.flatnonzero(starts), 1)
                    np.add.at(edge, np.flatnonzero(starts) + window, -1)
                    words = list(compress(words, (np.cumsum(edge[:-1]) == 0).tolist()))
                text = b" ".join(words)
                sizes.append(n)
                gone.append(n - len(words))
                shas.append(hashlib.sha256(text).hexdigest())
                texts.append(text)
            cols = [pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(shas, pa.string())]
            out, names = [batch.column("uid"), batch.column("doc_id"), *cols], ["uid", "doc_id", "n_words", "n_removed", "kept_sha256"]
            if "want_text" in batch.schema.names:
                out, names = [*out, pa.array(texts, pa.binary())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(out, names)

    return run


def remove_repeats(docs: DataFrame, *, window: int = 50, gram: int = 8, group_rows: int = 2048, text: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """uid, doc_id, n_words, n_removed and kept_sha256 of every document; with text also what is left, as ``kept``."""
    assert 0 < gram <= window
    spark = docs.sparkSession
    small_batches(spark)
    scratch = scratch or Scratch(spark, "substrings")
    docs = with_uid(docs.select("doc_id", "text"), scratch=scratch).select("uid", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("data"))
    runs = repeated_runs(docs, window=window, gram=gram, group_rows=group_rows, scratch=scratch)
    runs = scratch.save(runs.groupBy("uid").agg(F.collect_list(F.struct("start", "stop", "alone")).alias("runs")), "runs")
    scratch.drop("prefixes", "places", "nodes", "longer", "longer-counts", "longer-places", "alone")
    rows = docs.join(runs.hint("merge"), "uid", "left")
    schema = f"uid {UID}, doc_id long, n_words long, n_removed long, kept_sha256 string"
    if text:
        rows, schema = rows.withColumn("want_text", F.lit(True)), schema + ", kept binary"
    out = rows.mapInArrow(_remove(window), schema)
    return out.withColumn("kept", F.col("kept").cast("string")) if text else out
