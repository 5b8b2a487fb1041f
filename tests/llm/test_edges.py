"""Every operator and stage: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import corpus_pipeline
import numpy as np
import pytest

from helixsieve.llm import exact_dedup, langid, mixing, near_dedup, packing, sharding, substring_dedup, topk, url_reputation, warc
from helixsieve.llm.common import Scratch
from helixsieve.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, uid string, size int, row string, finish string, langid string"
EN, DE, FR = "the and of that with this for there", "der und die nicht mit sich auch einer", "le la les des une que pour dans"
LONG = " ".join(f"w{i}" for i in range(150_000))
ROWS = [
    (1, EN, "en", "a", 5, "x", 1, "r", "f", None),
    (2, EN + " ", "en", "a", 5, "x", 1, "r", "f", None),
    (2, EN + " ", "en", "a", 5, "x", 1, "r", "f", None),
    (3, DE, "de", None, None, None, None, None, None, None),
    (4, None, None, "b", None, None, None, None, None, None),
    (5, "", "fr", "b", 0, None, None, None, None, None),
    (6, " \n\t", "fr", None, 3, None, None, None, None, None),
    (7, FR, "fr", "c", 3, None, None, None, None, None),
    (None, FR, None, "c", 3, None, None, None, None, None),
    (8, LONG, "en", "c", len(LONG), None, None, None, None, None),
    (9, "### 123 $$$", None, "d", 11, None, None, None, None, None),
    (10, "Σ naïve \U0001f600 text " + DE, "de", "d", 1, None, None, None, None, None),
]


@pytest.fixture(params=["rows", "empty", "file"])
def docs(request, spark, tmp_path):
    df = spark.createDataFrame([] if request.param == "empty" else ROWS, DOCS)
    if request.param == "file":
        df.write.parquet(str(tmp_path / "d"))
        df = spark.read.parquet(str(tmp_path / "d"))
    return df


@pytest.fixture(params=["joined", "shuffled", "fanned out", "generated"])
def unscanned(request, spark, tmp_path):
    """50 texts, three rows of each: frames that are more than a scan of files."""
    spark.createDataFrame([(i, f"text number {i} of these fifty texts in all") for i in range(50)], "doc_id long, text string").write.parquet(str(tmp_path / "u"))
    one, three = spark.read.parquet(str(tmp_path / "u")), spark.range(3).withColumnRenamed("id", "copy")
    if request.param == "joined":
        return one.join(three)
    if request.param == "shuffled":
        return one.join(three).repartition(7)
    if request.param == "fanned out":
        return one.selectExpr("*", "explode(array(1, 2, 3)) as copy")
    return spark.range(150).selectExpr("id % 50 as doc_id", "concat('text number ', id % 50, ' of these fifty texts in all') as text")


def test_rows_that_are_no_scan(spark, unscanned):
    rows = exact_dedup.exact_dedup(unscanned).collect()
    assert len(rows) == 150 and all(r["group_size"] == 3 for r in rows)
    assert sorted(r["doc_id"] for r in rows if r["kept"]) == list(range(50))
    rows = near_dedup.near_dedup(unscanned, words=2).collect()
    assert len(rows) == 150 and len({r["uid"] for r in rows}) == 150
    assert sorted(r["doc_id"] for r in rows if r["first"]) == list(range(50))
    assert [r["n_removed"] for r in substring_dedup.remove_repeats(unscanned, window=4, gram=2).collect()] == [9] * 150
    rows = sharding.shard_by_bytes(unscanned, shards=7).collect()
    assert len({(r["shard"], r["slot"]) for r in rows}) == 150
    scratch = Scratch(spark, "t")
    warc.write_arc(unscanned.selectExpr("doc_id as page_id", "null as url", "text as html"), scratch.path("arc"))
    warc.convert_arc(spark, scratch.path("arc"), scratch.path("warc"), scratch=scratch)
    rows = warc.read_warc(spark, scratch.path("warc")).collect()
    assert sorted(r["page_id"] for r in rows if r["record_type"] == "response") == list(range(50)) and len(rows) == 150
    assert all(r["refers_to"] == r["page_id"] for r in rows if r["record_type"] == "revisit")
    for stage, n in ((corpus_pipeline.exact_duplicates, 50), (corpus_pipeline.near_duplicates, 50)):
        assert stage(spark, unscanned, "").count() == n


def by_id(df, *names):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(tuple(r[n] for n in names) if len(names) > 1 else r[names[0]])
    return out


def test_langid(docs):
    got = by_id(langid.identify(docs, langid.fit(docs)).select("row.doc_id", "langid.lang_pred", "langid.score"), "lang_pred", "score")
    assert sum(map(len, got.values())) == docs.count()
    for i in (4, 5, 6, 9):
        assert got.get(i, [("und", 0.0)]) == [("und", 0.0)]
    assert all(0 <= s <= 1 for own in got.values() for _, s in own)


def test_exact_dedup(docs):
    got = by_id(exact_dedup.exact_dedup(docs), "keep_id", "group_size", "kept")
    if got:
        assert got[1] == [(2, 3, False)]
        assert sorted(got[2]) == [(2, 3, False), (2, 3, True)]
        assert got[6] == [(6, 3, True)] and got[4] == [(6, 3, False)] and got[5] == [(6, 3, False)]
        assert got[7] == [(7, 2, True)] and got[None] == [(7, 2, False)]
        assert got[8] == [(8, 1, True)]


def test_near_dedup(docs):
    got = by_id(near_dedup.near_dedup(docs, words=2), "component_id", "n_shingles", "first")
    if got:
        assert got[1] == [(1, 7, True)] and got[2] == [(1, 7, False)] * 2
        assert got[4] == [(4, 0, True)] and got[6] == [(6, 0, True)]
        assert got[7] == [(7, 7, True)] and got[None] == [(7, 7, False)]
        assert got[8] == [(8, 149_999, True)]


def test_substrings(docs):
    got = by_id(substring_dedup.remove_repeats(docs, window=4, gram=2), "n_words", "n_removed")
    if got:
        assert got[1] == [(8, 8)] and got[2] == [(8, 8)] * 2 and got[7] == got[None] == [(8, 8)]
        assert got[4] == got[6] == [(0, 0)] and got[8] == [(150_000, 0)] and got[10] == [(12, 8)]


def test_packing(docs):
    rows = packing.pack(docs, tokenizer_path()).collect()
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by_seq.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.collect()}


def test_sharding(docs):
    rows = sharding.shard_by_bytes(docs, shards=3).collect()
    assert len(rows) == docs.count()
    for s in range(3):
        own = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert own == list(range(len(own)))


def test_mixing(docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    by_source = {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by_source.setdefault((r["source"], r["target"], r["source_size"]), 0)
        by_source[r["source"], r["target"], r["source_size"]] += r["taken"]
    for (_, target, size), taken in by_source.items():
        assert abs(taken - target) <= 1 and target <= 2 * size
    out = mixing.emit(docs)
    assert out.columns == docs.columns
    assert sum(len((r["text"] or "").split()) for r in out.collect()) == sum(r["taken"] for r in rows)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, docs, name, stage):
    out = stage(spark, docs, "")
    if name != "packing":
        assert out.columns == docs.columns
    got = sorted((r["doc_id"] or 0) for r in out.collect())
    if docs.count():
        want = {"language_id": [0, 1, 2, 2, 3, 7, 8, 10], "exact_dedup": [2, 3, 6, 7, 8, 9, 10], "near_dedup": [1, 3, 4, 5, 6, 7, 8, 9, 10]}
        assert got == want.get(name, got)
    else:
        assert not got


PAGES = "page_id long, url string, html string, host string, uid int, verdict string"
PAGE_ROWS = [
    (1, "http://A.Example.com/en/7?x", "<p>é</p>", "h", 1, "v"),
    (1, "http://A.Example.com/en/7?x", "<p>é</p>", "h", 1, "v"),
    (2, None, "<p>é</p>", None, None, None),
    (3, "no scheme", None, None, None, None),
    (4, "ftp://x.org/es/a b\nc#f", "", None, None, None),
    (None, "://net/de/", "WARC/1.0\r\n\r\nContent-Length: 3\r\n\r\n", None, None, None),
    (5, "https://example.net/de/88", "y" * 3_000_000, None, None, None),
]


@pytest.mark.parametrize("rows", [PAGE_ROWS, []])
def test_urls(spark, rows):
    pages = spark.createDataFrame(rows, PAGES)
    labels = spark.createDataFrame([(1, True), (1, False), (2, None), (None, True)] if rows else [], "page_id long, bad boolean")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_reputation.filter_urls(pages, labels).collect()}
    if rows:
        assert got[1] == ("a.example.com", "/en/7", "example.com/en/7", "allow")
        assert got[2] == got[3] == ("", "", None, "allow")
        assert got[4] == ("x.org", "/es/a b\nc", "org/es/", "block")
        assert got[None] == ("net", "/de/", "net/de/", "allow")
        assert got[5] == ("example.net", "/de/88", "example.net/de/8", "block")


@pytest.mark.parametrize("rows", [PAGE_ROWS, []])
def test_warc(spark, rows):
    scratch = Scratch(spark, "t")
    warc.write_arc(spark.createDataFrame(rows, PAGES), scratch.path("arc"))
    warc.convert_arc(spark, scratch.path("arc"), scratch.path("warc"), scratch=scratch)
    got = sorted(((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read_warc(spark, scratch.path("warc")).collect()), key=str)
    if rows:
        assert got == sorted([(0, 33, "response", None), (1, 9, "response", None), (1, 9, "revisit", 1), (2, 9, "revisit", 1), (3, 0, "response", None), (4, 0, "revisit", 3), (5, 3_000_000, "response", None)], key=str)
    else:
        assert not got


def test_topk(spark):
    rows = [(i, [float(i % 7), 1.0, 0.5]) for i in range(60)] + [(60, None), (61, [None, 1.0, 2.0]), (62, [float("nan"), 1.0, 1.0]), (63, [float("inf"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (64, []), (65, [3.0])]
    rows += [(40, [1e30, 1.0, 1.0]), (140, [1e15, 1.0, 1.0]), (141, [-1e30, 0.0, 1.0]), (142, [1e30, 2.0, 1.0]), (7, [6.0, 1.0, 0.5]), (7, [6.0, 1.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'x' as score", "1 as block", "'y' as uid")
    out = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    f32 = lambda x: float(np.float32(x))
    whole = [(i, [int(64 * f32(x)) for x in [*v, 0, 0, 0][:3]]) for i, v in rows if v is not None and i is not None and i not in (61, 62, 63)]
    for shard_rows, block_rows in ((16, 2), (4096, 1 << 16)):
        got = topk.top_k(df, df.where("vec_id % 20 = 0"), k=5, shard_rows=shard_rows, block_rows=block_rows).collect()
        assert {r["query_id"] for r in got} == {0, 20, 40, 140}
        for q in (0, 20, 40, 140):
            own = min(v for i, v in whole if i == q)
            want = sorted((-sum(a * b for a, b in zip(own, v, strict=True)), i) for i, v in whole if i != q)[:5]
            assert [(r["rank"], r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == [(n + 1, i, out(-s)) for n, (s, i) in enumerate(want)]
    empty = df.limit(0)
    assert topk.top_k(empty, empty).count() == 0


def test_no_rules(spark):
    pages = spark.createDataFrame(PAGE_ROWS, PAGES)
    got = url_reputation.filter_urls(pages, spark.createDataFrame([], "page_id long, bad boolean"), rules=[]).collect()
    assert len(got) == len(PAGE_ROWS) and all(r["rule"] is None and r["verdict"] == "allow" for r in got)


def test_suffixes_of_several_labels(spark):
    hosts = spark.createDataFrame([("x.a.co.uk", 50, 50), ("y.a.co.uk", 0, 0), ("y.b.co.uk", 0, 0), ("c.co.uk", 50, 0), ("d.com", 50, 0)], "host string, n long, b long")
    rates = {r["host"]: r["rate"] for r in url_reputation.host_reputation(hosts, z=1.645, cut=0.5, suffixes=["co.uk"]).collect()}
    assert rates["y.a.co.uk"] > rates["y.b.co.uk"] + 0.1
