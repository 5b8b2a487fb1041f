"""Hierarchical language identification: a family first, then one-versus-one linear SVMs among its languages.

Features of a whole text are counts of hashed byte trigrams of its lower-cased UTF-8, as a unit vector of their square
roots. One linear SVM a family (one against the rest) picks the family; within it each pair of languages has its own
SVM, and the language with most votes wins (ties: larger sum of margins, then the smaller name). All SVMs minimise the
squared hinge loss with an L2 penalty by accelerated gradient steps on the driver.

They learn from a bounded sample of labelled rows: about ``per_language`` documents of each language, and not many more
than ``most_rows`` of all, by hash of doc_id, of the ``most_languages`` that most documents have. The driver gets them as
sparse counts, made on the executors from whole texts. Languages outside FAMILIES are a family of their own. Texts are
judged a batch at a time, by one product with the weights of all families and pairs.

A text that is null or has no letter is ``und`` with score 0; so is every text if no labelled row exists. A text of any
length is read whole. Repeated rows are judged alike. A null doc_id is not held out and not learned from. Extra columns,
of whatever names, are kept in ``row``. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixsieve.llm.common import small_batches

DIMS = 1 << 13
#: Families of common languages, by ISO 639-1 code.
FAMILIES = {
    "germanic": "en de nl sv da no is af lb fy yi".split(),
    "romance": "fr es it pt ro ca gl oc".split(),
    "slavic": "ru uk be bg sr hr sl sk cs pl mk".split(),
    "uralic": "fi et hu".split(),
    "turkic": "tr az kk uz ky tk".split(),
    "semitic": "ar he am mt".split(),
    "indic": "hi ur bn pa gu mr ne si".split(),
    "sinitic": "zh yue".split(),
}
_FAMILY = {x: f for f, own in FAMILIES.items() for x in own}
_LETTER = regex.compile(r"\p{L}")


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().replace("_", "-").split("-")[0], f"only {lang}")


def trigram_counts(text: str) -> np.ndarray:
    """Counts of hashed byte trigrams of a text with a space at either end; white space counts as a space."""
    x = np.frombuffer(b" " + text.lower().encode().translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")) + b" ", np.uint8).astype(np.uint32)
    h = (x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:]) * np.uint32(2654435761)
    return np.bincount(h >> np.uint32(19), minlength=DIMS)


def unit(counts: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts.astype(np.float32))
    return x / max(1e-9, float(np.sqrt((x * x).sum())))


def svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 150) -> tuple[np.ndarray, float]:
    """Weights and offset of a linear SVM; y is 1 or -1, both sides weigh alike, rows of x are unit vectors."""
    side = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum())).astype(np.float32)
    w = np.zeros(x.shape[1] + 1, np.float32)  # the offset last
    ahead, rate = w.copy(), 1 / (2 * 2 + penalty)
    for i in range(steps):
        pull = side * y * np.maximum(0, 1 - y * (x @ ahead[:-1] + ahead[-1]))
        new = ahead - rate * (penalty * ahead - 2 * np.append(pull @ x, pull.sum()))
        w, ahead = new, new + i / (i + 3) * (new - w)
    return w[:-1], float(w[-1])


def _sure(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-4 * margin))


class Model:
    """Weights of families, then of the pairs of languages within them, as rows of one matrix."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        own = np.array(langs)
        self.langs = sorted(set(langs))
        self.families = sorted({family(v) for v in self.langs})
        self.own = {f: [v for v in self.langs if family(v) == f] for f in self.families}
        self.pairs = [(a, b) for f in self.families for a, b in combinations(self.own[f], 2)]
        of = np.array([family(v) for v in langs])
        sign = lambda m: np.where(m, 1, -1).astype(np.float32)
        found = [svm(x, sign(of == f)) for f in self.families] if len(self.families) > 1 else []
        for a, b in self.pairs:
            m = (own == a) | (own == b)
            found.append(svm(x[m], sign(own[m] == a)))
        self.weights = np.array([w for w, _ in found], np.float32).reshape(len(found), x.shape[1])
        self.offsets = np.array([b for _, b in found], np.float32)

    def predict(self, texts: list[str | None], batch: int = 256) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        use = [i for i, t in enumerate(texts) if t is not None and self.langs and _LETTER.search(t)]
        for a in range(0, len(use), batch):
            rows = use[a : a + batch]
            margins = np.stack([unit(trigram_counts(texts[i])) for i in rows]) @ self.weights.T + self.offsets
            for i, got in zip(rows, self._judge(margins.astype(float)), strict=True):
                out[i] = got
        return out

    def _judge(self, margins: np.ndarray) -> list[tuple[str, float]]:
        n = len(self.families) if len(self.families) > 1 else 0
        if n:
            best = margins[:, :n].argmax(1)  # of equal ones the smaller name
            two = np.sort(margins[:, :n], axis=1)[:, -2:]
            score = _sure(two[:, 1] - two[:, 0])
        else:
            best, score = np.zeros(len(margins), int), np.ones(len(margins))
        out = []
        for f, s, row in zip(best.tolist(), score.tolist(), margins, strict=True):
            own = self.own[self.families[f]]
            votes = {v: [0, 0.0, 1.0] for v in own}
            for k, (a, b) in enumerate(self.pairs):
                if a in votes:
                    m = float(row[n + k])
                    votes[a if m > 0 else b][0] += 1
                    for lang, x in ((a, m), (b, -m)):
                        votes[lang][1] += x
                        votes[lang][2] = min(votes[lang][2], float(_sure(x)))
            lang = min(own, key=lambda v: (-votes[v][0], -votes[v][1], v))
            out.append((lang, s * votes[lang][2]))
        return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, *, per_language: int = 500, most_rows: int = 6000, most_languages: int = 500) -> Model:
    """Learn from rows that are not held out and have text and lang; see the module's bounds on the sample."""
    small_batches(docs.sparkSession)
    none = Model(np.zeros((0, DIMS), np.float32), [])
    rows = docs.select("doc_id", "lang", "text")
    rows = rows.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages).collect()
    if not sizes:
        return none
    share, scale = min(per_language, max(1, most_rows // len(sizes))), 1 << 30
    limits = [F.lit(v) for r in sizes for v in (r["lang"], min(scale, scale * share // r["n"]))]
    rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < F.element_at(F.create_map(*limits), F.col("lang")))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if _LETTER.search(text):
                    counts = trigram_counts(text)
                    at = np.flatnonzero(counts)
                    own.append((lang, at.astype("<u2").tobytes(), np.sqrt(counts[at]).astype("<f4").tobytes()))
            cols = zip(*own, strict=True) if own else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.binary(), pa.binary()), strict=True)], ["lang", "at", "x"])

    got = sorted((r["lang"], bytes(r["at"]), bytes(r["x"])) for r in rows.select("lang", "text").mapInArrow(features, "lang string, at binary, x binary").collect())
    if not got:
        return none
    x = np.zeros((len(got), DIMS), np.float32)
    for own, (_, at, values) in zip(x, got, strict=True):
        own[np.frombuffer(at, "<u2")] = np.frombuffer(values, "<f4")
    x /= np.maximum(1e-9, np.sqrt(np.einsum("ij,ij->i", x, x)))[:, None]
    return Model(x, [v for v, _, _ in got])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Each document as a struct ``row``, and a struct ``langid`` of lang_pred and score."""
    small_batches(docs.sparkSession)
    predict = F.pandas_udf(_predictor(model), "lang_pred string, score double")
    return docs.select(F.struct("*").alias("row"), predict(F.col("text")).alias("langid"))


def _predictor(model: Model) -> Callable:
    import pandas as pd

    def run(texts: pd.Series) -> pd.DataFrame:
        own = model.predict([None if t is None else t for t in texts])
        return pd.DataFrame({"lang_pred": [x[0] for x in own], "score": [x[1] for x in own]})

    run.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    return run
