"""Harmonic packing of token sequences.

Bins hold ``capacity`` tokens. A document longer than that gives whole bins first; what is left of it, or all of a
shorter one, is an item. Class k holds the items of more than capacity / (k + 1) and at most capacity / k tokens, and
its bins take k items each. A bin that has its k items has a gap smaller than any of them. Gaps are filled, too: by a
later item of a smaller class that fits whole, the tightest gap first, and if more than ``gaps`` bins wait for one, the
tightest is filled by waiting items that fit, and at last by a cut off a waiting item or off the emptiest bin. So most
documents stay in one piece and no sequence is padded: a worker's very last bin is cut at powers of two.

Each worker fills bins on its own, without a shuffle, and holds what waits: less than a bin a class, and ``gaps`` bins.

A null text is empty; every document ends in one end token, so no document is without tokens. A text of any length is
tokenised whole. Repeated rows are packed each on their own, and of ties the first to come is the first to be placed.
Extra columns are ignored. Sequence ids hold the worker's number in their high bits. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixsieve.llm.common import small_batches

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Words whose ids a worker keeps in each of two generations, of so many bytes at most.
CACHE_WORDS, CACHED_BYTES = 200_000, 48
#: How a tokenizer must normalise and split for :class:`WordIds` to apply: fixed values, as its file states them.
BY_WORD = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "truncation": None,
    "padding": None,
}
#: Only lower-case letters of ASCII and Latin-1, which no normalisation changes.
LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
#: A letter or digit, then only marks up to the word's end.
MARKS = re.compile(rb"(.*(?:[a-z0-9]|\xc3[\x9f-\xb6\xb8-\xbf]))([!#$%&*,.:;?|]+)", re.DOTALL)
#: Byte-level tokenizers show a byte as the character of its code, and bytes without a visible one from 256 on.
_SEEN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SHOWN = dict(zip(_SEEN, _SEEN, strict=True)) | {x: 256 + i for i, x in enumerate(sorted(set(range(256)) - set(_SEEN)))}


class WordIds(dict):
    """Ids of words, as bytes, of a byte-level tokenizer that ignores case and white space and sets marks apart.

    Such a tokenizer gives a text the ids of its words, one after another, and a word the ids of its letters and of
    the marks behind them; letters alone are one piece, which goes to the merges at once. Ids are kept in two
    generations: what has been used since the last change survives it.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.old = Tokenizer.from_file(path), {}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            if LETTERS.fullmatch(word):
                ids = array("I", [t.id for t in self.tokenizer.model.tokenize(word.decode("latin-1").translate(_SHOWN))]).tobytes()
            elif m := MARKS.fullmatch(word):
                ids = self[m[1]] + self[m[2]]
            else:
                ids = array("I", self.tokenizer.encode(word.decode(), add_special_tokens=False).ids).tobytes()
        if len(word) <= CACHED_BYTES:
            self[word] = ids
        return ids

    def of(self, text: bytes | None) -> np.ndarray:
        if text and b"<|" in text:  # special tokens are sought before all else
            return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, "<u4")
        ids = np.frombuffer(b"".join(map(self.__getitem__, (text or b"").lower().split())), "<u4")
        if len(self) > CACHE_WORDS:
            self.old = dict(self)
            self.clear()
        return ids


def by_word(path: str) -> bool:
    """Whether a tokenizer's file says that it works as :class:`WordIds` does."""
    with open(path, encoding="utf-8") as f:
        own = json.load(f)
    model = own.get("model") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
    special = all(t["content"].startswith("<|") and t["special"] and not (t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]) for t in own.get("added_tokens") or [])
    return plain and special and all(own.get(k) == v for k, v in BY_WORD.items())


def _whole(path: str) -> Callable[[bytes | None], np.ndarray]:
    """Ids of whole texts by any tokenizer."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    return lambda text: np.array(own.encode((text or b"").decode(), add_special_tokens=False).ids, "<u4")


_ENCODERS: dict[str, Callable[[bytes | None], np.ndarray]] = {}


def encoder(path: str) -> Callable[[bytes | None], np.ndarray]:
    """From a text's bytes to its ids; one for each worker process, kept for its later tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordIds(path).of if by_word(path) else _whole(path)
    return _ENCODERS[path]


#: A piece of a document: doc_id, place of its first id, ids, and the document's number of ids.
Piece = tuple[int | None, int, np.ndarray, int]


class Packer:
    """Fills one worker's bins. add() gives the rows of bins that are full, end() the rest."""

    def __init__(self, capacity: int, first_id: int, gaps: int = 64):
        assert capacity & (capacity - 1) == 0, "the capacity is a power of two"
        self.capacity, self.next_id, self.most = capacity, first_id, gaps
        self.waiting: dict[int, list[Piece]] = {}  # by class
        self.gaps: list[tuple[int, int, list[Piece]]] = []  # gap, number, pieces of bins that have their count
        self.number, self.full = 0, []

    def _emit(self, pieces: list[Piece]) -> None:
        at = 0
        for doc_id, start, ids, n in pieces:
            self.full.append((doc_id, start, len(ids), zlib.crc32(np.ascontiguousarray(ids)), n, self.next_id, at))
            at += len(ids)
        self.next_id += 1

    def _keep(self, gap: int, pieces: list[Piece]) -> None:
        """A bin that has its count: out if it is full, or else among those with a gap."""
        if not gap:
            self._emit(pieces)
            return
        self.number += 1
        insort(self.gaps, (gap, self.number, pieces))

    def _place(self, piece: Piece) -> None:
        size = len(piece[2])
        at = bisect_left(self.gaps, (size,))
        if at < len(self.gaps):
            gap, _, pieces = self.gaps.pop(at)
            self._keep(gap - size, [*pieces, piece])
            return
        k = self.capacity // size
        own = self.waiting.setdefault(k, [])
        own.append(piece)
        if len(own) == k:
            del self.waiting[k]
            self._keep(self.capacity - sum(len(p[2]) for p in own), own)

    def _fill(self, gap: int, pieces: list[Piece]) -> bool:
        """Fill a gap from what waits, or else from the emptiest bin; False if there is nothing, and the bin is kept."""
        while gap:
            fits = [k for k in self.waiting if k * gap >= self.capacity]
            if not self.waiting:
                if not self.gaps:
                    self._keep(gap, pieces)
                    return False
                k = 0
                self.waiting[0] = self.gaps.pop()[2]  # no class: pieces of a bin that is given up
            else:
                k = min(fits) if fits else min(self.waiting)
            piece = self.waiting[k].pop()
            if not self.waiting[k]:
                del self.waiting[k]
            rest = self.waiting.pop(0, [])
            doc_id, start, ids, n = piece
            pieces = [*pieces, (doc_id, start, ids[:gap], n)]
            rest += [(doc_id, start + gap, ids[gap:], n)] if len(ids) > gap else []
            gap -= min(gap, len(ids))
            for p in rest:
                self._place(p)
        self._emit(pieces)
        return True

    def _taken(self) -> list[tuple]:
        out, self.full = self.full, []
        return out

    def add(self, doc_id: int | None, ids: np.ndarray) -> list[tuple]:
        n, whole = len(ids), len(ids) - len(ids) % self.capacity
        for at in range(0, whole, self.capacity):
            self._emit([(doc_id, at, ids[at : at + self.capacity], n)])
        if whole < n:
            self._place((doc_id, whole, ids[whole:].copy(), n))
        while len(self.gaps) > self.most:
            gap, _, pieces = self.gaps.pop(0)
            if not self._fill(gap, pieces):  # no other bin, and nothing waits
                break
        return self._taken()

    def end(self) -> list[tuple]:
        while self.gaps or self.waiting:
            gap, _, pieces = self.gaps.pop(0) if self.gaps else (self.capacity, 0, [])
            if not self._fill(gap, pieces):
                break
        for gap, _, pieces in self.gaps:  # one at most: the last, cut at powers of two
            left, todo = self.capacity - gap, pieces[::-1]
            while left:
                room, own = 1 << (left.bit_length() - 1), []
                left -= room
                while room:
                    doc_id, start, ids, n = todo.pop()
                    own.append((doc_id, start, ids[:room], n))
                    if len(ids) > room:
                        todo.append((doc_id, start + room, ids[room:], n))
                    room -= min(room, len(ids))
                self._emit(own)
        self.gaps = []
        return self._taken()


def pack(docs: DataFrame, tokenizer_path: str, *, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """A row for each piece of a document: see SCHEMA. offset is the piece's place in its sequence."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer_path), np.array([end_id], "<u4")
        packer = Packer(capacity, TaskContext.get().partitionId() << 40)

        def rows(x: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*x, strict=True)) or [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out += packer.add(doc_id, np.concatenate([encode(text), end]))
            yield rows(out)
        yield rows(packer.end())

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("data")).mapInArrow(run, SCHEMA)
