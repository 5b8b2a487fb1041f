"""Exact de-duplication by composable polynomial fingerprints.

A text's bytes are a polynomial's coefficients. Chunks are hashed on their own, in any order and place, and combine by
length-shifted arithmetic: ``H(a + b) = H(a) * B ** len(b) + H(b)``. A text beyond ``spread`` bytes is cut into chunks that
are dealt out over all tasks, and its fingerprint is put together from theirs; a shorter one is hashed where it is
read. Rows of equal fingerprint and length are compared chunk by chunk before they count as copies, so a collision can't
drop a document.

Nulls count as empty texts; empty texts are equal. Of equal texts the one with most code points stays, of these that of
the smallest doc_id; a null doc_id is ranked after all others, and of rows that tie in both the first by file and place
stays. Repeated rows are copies of each other, of which one stays. Extra columns are ignored here. An empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixsieve.llm.common import SPACE_BYTES, Scratch, small_batches, with_uid

#: The moduli are the two largest primes below 2**31.
MODULI = (2147483647, 2147483629)
BASES = (1000003, 69069069)
CHUNK = 1 << 16
#: Bytes of chunks that are handed on at a time.
BATCH = 8 << 20
UID = "struct<f:long,r:long>"
KEYS = f"uid {UID}, doc_id long, n_cp long"


def _powers(base: int, mod: int) -> np.ndarray:
    """base ** (CHUNK - 1), ..., base, 1 modulo mod, by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) < CHUNK:
        out = np.concatenate([out * np.uint64(pow(base, len(out), mod)) % np.uint64(mod), out])
    return out


_TABLES: dict[int, np.ndarray] = {}


def chunk_hash(data: bytes) -> tuple[int, int, int]:
    """Two residues and the length of at most CHUNK bytes."""
    x = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    out = []
    for base, mod in zip(BASES, MODULI, strict=True):
        if mod not in _TABLES:
            _TABLES[mod] = _powers(base, mod)
        out.append(int(np.dot(x, _TABLES[mod][CHUNK - len(x) :]) % np.uint64(mod)) if len(x) else 0)
    return out[0], out[1], len(data)


def combine(parts: Iterable[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The hash of a concatenation, from its parts' hashes."""
    a = b = n = 0
    for x, y, k in parts:
        a = (a * pow(BASES[0], k, MODULI[0]) + x) % MODULI[0]
        b = (b * pow(BASES[1], k, MODULI[1]) + y) % MODULI[1]
        n += k
    return a, b, n


def fingerprint(data: bytes) -> tuple[int, int, int]:
    return combine(chunk_hash(data[i : i + CHUNK]) for i in range(0, len(data), CHUNK))


def normalised(text: bytes | None) -> bytes:
    return (text or b"").translate(None, SPACE_BYTES)


def _chunks(data: bytes, size: int) -> Iterator[tuple[int, bytes]]:
    """Number and bytes of each chunk; an empty text is one empty chunk."""
    for k, at in enumerate(range(0, max(1, len(data)), size)):
        yield k, data[at : at + size]


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = []
        for text in batch.column("data").to_pylist():
            x = normalised(text)
            a, b, n = fingerprint(x)
            own.append((a << 31 | b, n, hashlib.sha256(x).hexdigest()))
        fp, size, sha = zip(*own, strict=True) if own else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("doc_id"), batch.column("n_cp"), pa.array(fp, pa.int64()), pa.array(size, pa.int64()), pa.array(sha, pa.string())], ["uid", "doc_id", "n_cp", "fp", "n_bytes", "text_sha256"])


def _cut(size: int, keep: list[str], sha: bool):
    """Rows (keep, k, chunk, and with sha the whole text's digest) of each text's chunks, a few MB at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for i, text in enumerate(batch.column("data").to_pylist()):
                x = normalised(text)
                digest = hashlib.sha256(x).hexdigest() if sha else None
                for k, chunk in _chunks(x, size):
                    rows.append((i, k, chunk, digest))
                    held += len(chunk)
                    if held >= BATCH:
                        yield table(batch, rows)
                        rows, held = [], 0
            if rows:
                yield table(batch, rows)

    def table(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        at, k, chunk, digest = zip(*rows, strict=True)
        own = [batch.column(c).take(pa.array(at, pa.int64())) for c in keep]
        more = [pa.array(digest, pa.string())] if sha else []
        return pa.RecordBatch.from_arrays([*own, pa.array(k, pa.int32()), pa.array(chunk, pa.binary()), *more], [*keep, "k", "chunk", *["text_sha256"] * sha])

    return run


def _hash_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [chunk_hash(x) for x in batch.column("chunk").to_pylist()]
        cols = [pa.array([x[i] for x in own], pa.int64()) for i in range(3)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("uid", "doc_id", "n_cp", "k", "text_sha256")), *cols], ["uid", "doc_id", "n_cp", "k", "text_sha256", "a", "b", "n"])


def _combine_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [combine((p["a"], p["b"], p["n"]) for p in parts) for parts in batch.column("parts").to_pylist()]
        fp, size = pa.array([a << 31 | b for a, b, _ in own], pa.int64()), pa.array([n for _, _, n in own], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("doc_id"), batch.column("n_cp"), fp, size, batch.column("text_sha256")], ["uid", "doc_id", "n_cp", "fp", "n_bytes", "text_sha256"])


def fingerprints(docs: DataFrame, spread: int) -> DataFrame:
    """uid, doc_id, n_cp, fp, n_bytes and text_sha256 of docs (uid, doc_id, n_cp, data)."""
    schema = f"{KEYS}, fp long, n_bytes long, text_sha256 string"
    here = docs.where(F.octet_length("data") <= spread).mapInArrow(_prints, schema)
    cut = docs.where(F.octet_length("data") > spread).mapInArrow(_cut(CHUNK, ["uid", "doc_id", "n_cp"], True), f"{KEYS}, k int, chunk binary, text_sha256 string")
    hashed = cut.repartition("uid", "k").mapInArrow(_hash_chunks, f"{KEYS}, k int, text_sha256 string, a long, b long, n long")
    whole = hashed.groupBy("uid", "doc_id", "n_cp", "text_sha256").agg(F.sort_array(F.collect_list(F.struct("k", "a", "b", "n"))).alias("parts"))
    return here.unionByName(whole.mapInArrow(_combine_chunks, schema))


def exact_dedup(docs: DataFrame, *, compare_group: int = 256, chunk_bytes: int = CHUNK, spread: int = 16 * CHUNK, scratch: Scratch | None = None) -> DataFrame:
    """One row per document: uid, doc_id, keep_id, group_size, kept, text_sha256.

    compare_group: how many members of a large group meet one copy of its first text while they are compared.
    spread: bytes beyond which a text's chunks are hashed apart from each other.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = scratch or Scratch(spark, "exact-dedup")
    docs = with_uid(docs.select("doc_id", "text"), scratch=scratch)
    docs = docs.select("uid", F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_cp"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"))
    prints = scratch.save(fingerprints(docs, spread), "prints")

    groups = prints.groupBy("fp", "n_bytes").agg(F.count("*").alias("n"), F.min("uid").alias("first")).where("n > 1")
    groups = scratch.save(groups, "groups")
    members = scratch.save(prints.select("uid", "fp", "n_bytes").join(groups, ["fp", "n_bytes"]).select("uid", "n", "first"), "members")

    # Merge hints: joins that meet texts are done the same way at every size.
    texts = members.hint("merge").join(docs.select("uid", "data"), "uid").select("uid", "n", "first", "data")
    chunks = lambda of: of.mapInArrow(_cut(chunk_bytes, ["uid", "n", "first"], False), f"uid {UID}, n long, first {UID}, k int, chunk binary")
    salts = F.ceil(F.col("n") / compare_group).cast("int")
    firsts = chunks(texts.where("uid = first")).select("first", "k", F.col("chunk").alias("first_chunk"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    others = chunks(texts.where("uid != first")).withColumn("salt", F.pmod(F.xxhash64("uid"), salts.cast("long")).cast("int"))
    unequal = others.join(firsts, ["first", "k", "salt"], "left").where("first_chunk is null or chunk != first_chunk")
    unequal = scratch.save(unequal.select("uid").distinct(), "unequal")

    # A group's name: its first row and, for rows of the same fingerprint whose bytes differ, their own digest.
    named = prints.join(groups, ["fp", "n_bytes"], "left").join(unequal.withColumn("differs", F.lit(True)), "uid", "left")
    named = named.select("uid", "doc_id", "n_cp", "text_sha256", F.coalesce("first", "uid").alias("first"), F.when(F.col("differs"), F.col("text_sha256")).otherwise("").alias("other"), F.col("first").isNotNull().alias("many"))
    named = scratch.save(named, "named")
    best = F.min(F.struct((-F.col("n_cp")).alias("longest"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid")).alias("best")
    keepers = scratch.save(named.where("many").groupBy("first", "other").agg(best, F.count("*").alias("group_size")), "keepers")
    out = named.join(keepers, ["first", "other"], "left")
    return out.select("uid", "doc_id", F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.coalesce(F.col("best.uid") == F.col("uid"), F.lit(True)).alias("kept"), "text_sha256")
