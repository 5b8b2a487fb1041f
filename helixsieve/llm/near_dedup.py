"""Near-duplicates by MinHash and an LSH forest.

A document's set is its distinct word shingles, as 64-bit hashes. Documents of equal sets (equal BLAKE2b digest of the
sorted set) are one class from the start, and one of them stands for it. Classes have a signature and ``trees`` sequences
of ``depth`` MinHash values. Each tree is the classes sorted by its sequence; classes that share the longest prefixes are
neighbours. A region of a tree, the classes below one prefix, is taken as it is if it has at most ``region`` classes,
and otherwise split by the next value: the depth adapts to how dense a region is. Within a region signatures are
compared: pairs that may be above the threshold become candidates. Every candidate is confirmed on the full sets. Links
make components. A first round over some trees takes only spanning forests of what is likely alike, down to full depth,
where a region that is still larger is covered by overlapping blocks. For the second, over all trees, what the first's
confirmed links have joined is one, all other pairs are asked anew, and a region that is larger than ``region`` after
``whole`` values is not split but compared whole, on the full sets, block against block.

No partner is dropped for being one of many: whatever shares ``whole`` values in some tree is compared, however dense
its region. The trees are range-partitioned by the whole sequence and the class; each task hands on its first and last
``region`` rows, and regions that cross a border are compared on these. Pairs of blocks are dealt by hash. So a hot group
spreads over many tasks. A dense region's comparisons grow with the square of its classes, their rows with the square
over the rows of a block.

Without words or text a set is empty and links with nothing. With fewer words than a shingle the whole sequence is one
shingle. A text of any length is read whole. A null doc_id ranks after all others, as null. Repeated rows are of one
class; of rows that tie in doc_id the first by file and place stands for a component. Empty tables give an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixsieve.llm.common import Scratch, small_batches, with_uid
from helixsieve.llm.components import components
from helixsieve.llm.words import U, grams, mix, word_hashes

SIGNATURE = 128
NO_ID = (1 << 63) - 1
ID = "struct<d:long,f:long,r:long>"
#: Standard deviations of the estimate below the threshold that a pair is still asked at: at 0.8 3 in 100 million are not.
SIFT = 6
#: Classes and shingles in a block of a dense region, on average at most.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 19
#: Shingles of so many of a cell's rows are counted by a matrix product, others pair by pair.
COMMON = 32


def shingles(text: bytes | None, words: int) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles; A-Z are lower-cased first."""
    own = word_hashes((text or b"").lower())
    if not len(own):
        return own
    return np.unique(grams(own, words) if len(own) >= words else grams(own, len(own)))


def _functions(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1 << 31, dtype=np.uint32, size=n) * np.uint32(2) + np.uint32(1), rng.integers(1 << 32, dtype=np.uint32, size=n)


def minhash(own: np.ndarray, functions: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """One minimum a function, over the set's upper halves."""
    x, (a, b) = (own >> U(32)).astype(np.uint32), functions
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        part = x[i : i + 2048]
        np.minimum(out, (np.multiply.outer(a, part) + b[:, None]).min(1), out=out)
    return out


def _sets(docs: DataFrame, words: int, trees: int, depth: int, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        functions = _functions(SIGNATURE + trees * depth, seed)
        for batch in batches:
            cols: list[list] = [[], [], [], []]
            for text in batch.column("data").to_pylist():
                own = shingles(text, words)
                row = [len(own), None, None, None]
                if len(own):
                    got = mix(minhash(own, functions).astype(np.uint64))  # minima are small; mixed, every bit tells them apart
                    row[1] = hashlib.blake2b(own.astype("<u8").tobytes(), digest_size=16).digest()
                    row[2] = (got[:SIGNATURE] >> U(56)).astype(np.uint8).tobytes()
                    row[3] = (got[SIGNATURE:] >> U(32)).astype(">u4").tobytes()
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            types = [pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["id", "n", "digest", "sig", "paths"])

    return docs.select("id", F.col("text").cast("binary").alias("data")).mapInArrow(run, f"id {ID}, n long, digest binary, sig binary, paths binary")


def _leaves(lcp: np.ndarray, region: int, depth: int, whole: int | None = None) -> Iterator[tuple[int, int]]:
    """Regions of sorted rows, of two rows at least; lcp[i] is what rows i and i + 1 share, -1 between trees.

    With whole, regions that are larger after so many values are left to :func:`dense_links`.
    """
    todo = [(0, len(lcp) + 1, -1)]
    while todo:
        a, b, level = todo.pop()
        if b - a < 2:
            continue
        if level >= 0 and b - a <= region:
            yield a, b
        elif whole is not None and level >= whole:
            continue
        elif level >= depth:
            for at in range(a, b, region // 2):
                yield at, min(b, at + region)
                if at + region >= b:
                    break
        else:
            cuts = np.flatnonzero(lcp[a : b - 1] <= level) + a + 1
            edges = np.concatenate([[a], cuts, [b]])
            for i in np.flatnonzero(np.diff(edges) > 1):
                todo.append((int(edges[i]), int(edges[i + 1]), level + 1))


def _region_pairs(sig: np.ndarray, size: np.ndarray, known: np.ndarray, low: float, part: float, near: bool) -> list[tuple[int, int]]:
    """Candidates among a region's rows, of which those of equal ``known`` are linked already.

    With near all pairs estimated at ``low`` or more, for a spanning edge that the full sets refuse would hide others;
    without, a forest that spans them.
    """
    order = np.argsort(size, kind="stable")
    sig, size, known = sig[order], size[order], known[order]
    alike = (sig[:, None, :] == sig[None, :, :]).sum(2, dtype=np.int16) / SIGNATURE
    alike[size[:, None] < part * size[None, :]] = 0
    alike = np.minimum(alike, alike.T)
    alike[known[:, None] == known[None, :]] = 0
    found = np.argwhere(np.triu(alike >= low)).tolist() if near else _forest(alike >= low, known)[0]
    return [(int(order[a]), int(order[b])) for a, b in found]


def _forest(strong: np.ndarray, known: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Edges of strong that span the parts it makes of rows of equal ``known``, and each row's part."""
    out, label = [], np.full(len(known), -1)
    for root in range(len(known)):
        if label[root] >= 0:
            continue
        todo = np.flatnonzero(known == known[root]).tolist()
        label[todo] = root
        while todo:
            u = todo.pop()
            for v in np.flatnonzero(strong[u] & (label < 0)).tolist():
                if label[v] < 0:
                    more = np.flatnonzero(known == known[v])
                    label[more] = root
                    out.append((u, v))
                    todo += more.tolist()
    return out, label


def _common(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """How many values each two rows share; values[i] is one of row[i]'s, once."""
    _, of, count = np.unique(values, return_inverse=True, return_counts=True)
    out = np.zeros((rows, rows), np.float32)
    often = np.flatnonzero(count >= COMMON)
    place = np.full(len(count), -1)
    place[often] = np.arange(len(often))
    for a in range(0, len(often), 2048):
        has = np.zeros((rows, min(2048, len(often) - a)), np.float32)
        here = (place[of] >= a) & (place[of] < a + has.shape[1])
        has[row[here], place[of[here]] - a] = 1
        out += has @ has.T
    few = np.flatnonzero((count[of] > 1) & (count[of] < COMMON))
    few = few[np.argsort(of[few], kind="stable")]
    of, row, flat = of[few], row[few], out.reshape(-1)
    for k in range(1, COMMON - 1):
        at = np.flatnonzero(of[k:] == of[:-k])
        np.add.at(flat, np.concatenate([row[at] * rows + row[at + k], row[at + k] * rows + row[at]]), np.float32(1))
    return out


def _cell_links(sets: list[np.ndarray], known: np.ndarray, side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links on the full sets that span what is alike in a block (side 0 only), or between two (sides 0 and 1)."""
    size = np.array([len(s) for s in sets])
    both = _common(np.concatenate(sets), np.repeat(np.arange(len(sets)), size), len(sets)).astype(np.int64)
    strong = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    strong &= known[:, None] != known[None, :]
    if side.any():
        strong &= side[:, None] != side[None, :]
    return _forest(strong, known)[0]


def dense_members(classes: DataFrame, *, trees: int, depth: int, region: int, whole: int) -> DataFrame:
    """(id, known, key, i, j, side): the rows of each pair of blocks (i, j), i <= j, of every dense region."""
    rows = classes.select("id", "n", "known", "paths", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    key = F.xxhash64("tree", F.substr("paths", F.col("tree") * (4 * depth) + 1, F.lit(4 * whole)))
    rows = rows.select("id", "n", "known", key.alias("key"))
    groups = rows.groupBy("key").agg(F.count("*").alias("k"), F.sum("n").alias("s"), (F.min("known") != F.max("known")).alias("open")).where(f"k > {region} and open")
    groups = groups.select("key", F.ceil(F.greatest(F.col("k") / BLOCK, F.col("s") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    rows = rows.join(groups, "key").withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    rows = rows.select("id", "known", "key", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return rows.select("id", "known", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"))


def dense_links(members: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Links (a, b), a < b, among dense_members, by their full sets (id, own)."""
    cell = ["key", "i", "j"]
    rows = members.hint("merge").join(full, "id").repartition(*cell).sortWithinPartitions(*cell)

    def links(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        known = rows.column("known").to_numpy()
        if len(rows) < 2 or (known == known[0]).all():
            return
        sets = [s.values.to_numpy() for s in rows.column("own")]
        if found := _cell_links(sets, known, rows.column("side").to_numpy(), percent):
            id_ = rows.column("id").combine_chunks()
            yield pa.RecordBatch.from_arrays([id_.take(pa.array(x, pa.int64())) for x in zip(*found, strict=True)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        at = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in cell], 1)
            edges = [0, *(np.flatnonzero((cells[1:] != cells[:-1]).any(1)) + 1).tolist(), len(cells)]
            for a, b in zip(edges, edges[1:], strict=False):
                if kept and tuple(cells[a]) != at:
                    yield from links(pa.Table.from_batches(kept))
                    kept = []
                at = tuple(cells[a])
                kept.append(batch.slice(a, b - a))
        if kept:
            yield from links(pa.Table.from_batches(kept))

    out = rows.mapInArrow(run, f"a {ID}, b {ID}")
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct()


def candidates(classes: DataFrame, *, which: range, near: bool, depth: int, region: int, threshold: float, whole: int, scratch: Scratch, name: str) -> DataFrame:
    """Pairs (a, b), a < b, of classes (id, n, sig, paths, known) that meet in some trees and have other ``known``.

    Without near only spanning forests of what is likely above the threshold; with it all that may be above, but for
    the dense regions.
    """
    deviation = (threshold * (1 - threshold) / SIGNATURE) ** 0.5
    low = threshold - SIFT * deviation if near else threshold + deviation / 2
    tree = F.explode(F.sequence(F.lit(which.start), F.lit(which.stop - 1)))
    rows = classes.select("id", "n", "sig", "paths", "known", tree.alias("tree"))
    key = F.concat(F.unhex(F.lpad(F.hex("tree"), 4, "0")), F.substr("paths", F.col("tree") * (4 * depth) + 1, F.lit(4 * depth)))
    rows = rows.select(key.alias("key"), "id", "n", "sig", "known").repartitionByRange("key", "id").sortWithinPartitions("key", "id")
    row_names = ["key", "id", "n", "sig", "known"]

    def pairs(table: pa.Table, gap: np.ndarray | None = None) -> tuple[pa.Array, pa.Array]:
        """Both ends of a table's pairs; rows that say gap are followed by others than the next."""
        table = table.combine_chunks()
        n, width = len(table), 2 + 4 * depth
        key = np.frombuffer(b"".join(table.column("key").to_pylist()), np.uint8).reshape(n, width)
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(n, SIGNATURE)
        size = table.column("n").to_numpy().astype(float)
        path = key[:, 2:].copy().view(">u4")
        same = np.logical_and.accumulate(path[1:] == path[:-1], axis=1).sum(1)
        same[(key[1:, :2] != key[:-1, :2]).any(1)] = -1
        if gap is not None:
            same[gap[:-1]] = -1
        known, found = table.column("known").to_numpy(), []
        for a, b in _leaves(same, region, depth, whole if near else None):
            found += [(a + i, a + j) for i, j in _region_pairs(sig[a:b], size[a:b], known[a:b], low, threshold, near)]
        ids, ends = table.column("id").combine_chunks(), np.array(found, np.int64).reshape(-1, 2)
        return ids.take(pa.array(ends[:, 0])), ids.take(pa.array(ends[:, 1]))

    def met(table: pa.Table) -> pa.RecordBatch:
        a, b = pairs(table)
        more = [pa.nulls(len(a), table.schema.field(c).type) for c in row_names]
        return pa.RecordBatch.from_arrays([a, b, *more, pa.nulls(len(a), pa.bool_())], ["a", "b", *row_names, "gap"])

    def border(table: pa.Table, last: bool) -> pa.RecordBatch:
        """Rows that are compared across tasks; with last, others follow the last one."""
        table = table.combine_chunks()
        none, n = pa.nulls(len(table), table.schema.field("id").type), len(table)
        own = [table.column(c).combine_chunks() for c in row_names]
        return pa.RecordBatch.from_arrays([none, none, *own, pa.array([last and i == n - 1 for i in range(n)], pa.bool_())], ["a", "b", *row_names, "gap"])

    def run(batches: Iterator[pa.RecordBatch], most: int = 50_000) -> Iterator[pa.RecordBatch]:
        """Blocks of rows; each begins with the last ``region`` rows of the one before."""
        kept: list[pa.RecordBatch] = []
        size, seen, begun = 0, 0, False
        for batch in batches:
            kept.append(batch)
            size, seen = size + batch.num_rows, seen + batch.num_rows
            if size < most:
                continue
            table = pa.Table.from_batches(kept)
            if not begun:
                yield border(table.slice(0, region), True)
            yield met(table)
            begun, kept, size = True, table.slice(size - region).to_batches(), region
        if not seen:
            return
        table = pa.Table.from_batches(kept)
        yield met(table)
        if not begun and size <= 2 * region:
            yield border(table, False)
            return
        if not begun:
            yield border(table.slice(0, region), True)
        yield border(table.slice(max(0, size - region)), False)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if own := [b for b in batches if b.num_rows]:
            table = pa.Table.from_batches(own)
            yield pa.RecordBatch.from_arrays(list(pairs(table, table.column("gap").to_numpy())), ["a", "b"])

    kinds = ", ".join(f"{c} {k}" for c, k in (("key", "binary"), ("id", ID), ("n", "long"), ("sig", "binary"), ("known", "long")))
    out = scratch.save(rows.mapInArrow(run, f"a {ID}, b {ID}, {kinds}, gap boolean"), name)
    # 2 * region rows a task of the range exchange, in one task: bounded by the shuffle partitions.
    borders = out.where("key is not null").select(*row_names, "gap").repartition(1).sortWithinPartitions("key", "id")
    out = out.where("a is not null").select("a", "b").unionByName(borders.mapInArrow(across, f"a {ID}, b {ID}"))
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct()


def _linked(sets_a: Column, sets_b: Column, percent: int) -> Column:
    both, a, b = (F.size(x).cast("long") for x in (F.array_intersect(sets_a, sets_b), sets_a, sets_b))
    return 100 * both >= percent * (a + b - both)


def near_dedup(docs: DataFrame, *, words: int = 5, percent: int = 80, trees: int = 16, depth: int = 8, region: int = 96, first_trees: int = 4, whole: int = 3, seed: int = 5, scratch: Scratch | None = None) -> DataFrame:
    """uid, doc_id, n_shingles, component_id and first (whether the row stands for its component) of every document."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = scratch or Scratch(spark, "near-dedup")
    docs = with_uid(docs.select("doc_id", "text"), scratch=scratch).select(F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("d"), "uid.f", "uid.r").alias("id"), "text")
    rows = scratch.save(_sets(docs, words, trees, depth, seed), "rows")
    classes = scratch.save(rows.where("n > 0").groupBy("digest").agg(F.min("id").alias("class")), "classes")
    firsts = rows.join(classes.select(F.col("class").alias("id")).hint("merge"), "id", "left_semi").select("id", "n", "sig", "paths")
    firsts = scratch.save(firsts, "firsts")
    whole = min(whole, depth)
    how = {"depth": depth, "region": region, "threshold": percent / 100, "whole": whole, "scratch": scratch}

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingles(t, words).view(np.int64) for t in batch.column("data").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(own, pa.list_(pa.int64()))], ["id", "own"])

    def full_sets(asked: DataFrame, name: str) -> DataFrame:
        asked = scratch.save(asked.distinct(), f"asked{name}")
        texts = docs.join(asked.hint("merge"), "id", "left_semi").select("id", F.col("text").cast("binary").alias("data"))
        full = scratch.save(texts.mapInArrow(sets, f"id {ID}, own array<long>"), f"full{name}")
        return full

    def links(pairs: DataFrame, name: str) -> DataFrame:
        """Pairs that the full sets confirm. Merge hints: joins that meet texts or sets are done alike at every size."""
        full = full_sets(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))), name)
        met = pairs.hint("merge").join(full.select(F.col("id").alias("a"), F.col("own").alias("own_a")), "a")
        met = met.hint("merge").join(full.select(F.col("id").alias("b"), F.col("own").alias("own_b")), "b")
        out = scratch.save(met.where(_linked(F.col("own_a"), F.col("own_b"), percent)).select("a", "b"), f"links{name}")
        scratch.drop(f"asked{name}", f"full{name}")
        return out

    # What is likely alike in the first trees is linked first; what is linked already is no candidate in all trees.
    first = range(min(first_trees, trees))
    early = scratch.save(candidates(firsts.withColumn("known", F.xxhash64("id")), which=first, near=False, name="met1", **how), "early")
    linked = components(links(early, "1"), scratch)
    known = firsts.join(linked.select(F.col("node").alias("id"), "root"), "id", "left")
    known = scratch.save(known.withColumn("known", F.xxhash64(F.coalesce("root", "id"))).drop("root"), "known")
    scratch.drop("firsts")
    members = scratch.save(dense_members(known, trees=trees, depth=depth, region=region, whole=whole), "members")
    dense = scratch.save(dense_links(members, full_sets(members.select("id"), "-dense"), percent), "dense")
    scratch.drop("members", "asked-dense", "full-dense")
    late = candidates(known, which=range(trees), near=True, name="met2", **how).join(early, ["a", "b"], "left_anti")
    more = links(scratch.save(late, "late"), "2")
    roots = components(more.unionByName(dense).unionByName(linked.select(F.col("node").alias("a"), F.col("root").alias("b"))), scratch)
    scratch.drop("known", "dense", "early", "late", "met1", "met2", "links1", "links2")

    named = classes.join(roots.select(F.col("node").alias("class"), "root"), "class", "left")
    named = scratch.save(named.select("digest", F.coalesce("root", "class").alias("root")), "named")
    out = rows.select("id", "n", "digest").join(named, "digest", "left").withColumn("root", F.coalesce("root", "id"))
    real = lambda x: F.when(x != NO_ID, x)
    return out.select(F.struct("id.f", "id.r").alias("uid"), real(F.col("id.d")).alias("doc_id"), F.col("n").alias("n_shingles"), real(F.col("root.d")).alias("component_id"), (F.col("id") == F.col("root")).alias("first"))
