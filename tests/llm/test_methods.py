"""The operators' methods against plain versions, on random small inputs and on the queries' contracts."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helixsieve.llm import exact_dedup, langid, mixing, near_dedup, packing, sharding, substring_dedup, topk, url_reputation, warc, words
from helixsieve.llm.common import Scratch
from helixsieve.llm.components import components
from helixsieve.llm.queries import queries, tokenizer_path

SF = "/root/testdata/sf0.001"


@given(st.binary(max_size=300), st.lists(st.integers(0, 300), max_size=5))
def test_fingerprints_compose(data, cuts):
    at = sorted({0, len(data), *(min(c, len(data)) for c in cuts)})
    parts = [exact_dedup.chunk_hash(data[a:b]) for a, b in zip(at, at[1:], strict=False)]
    assert exact_dedup.combine(parts) == exact_dedup.fingerprint(data)
    if data:
        assert exact_dedup.fingerprint(data) != exact_dedup.fingerprint(data[:-1] + bytes([data[-1] ^ 1]))


def test_unequal_texts_of_one_fingerprint(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "fingerprint", lambda data: (1, 1, len(data)))
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(exact_dedup)
    try:
        docs = spark.createDataFrame([(1, "abc"), (2, "abd"), (3, "a bc"), (4, "abd"), (5, "xyz")], "doc_id long, text string")
        got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(docs, chunk_bytes=2).collect()}
    finally:
        cloudpickle.unregister_pickle_by_value(exact_dedup)
    assert got == {1: (3, 2), 3: (3, 2), 2: (2, 2), 4: (2, 2), 5: (5, 1)}


@given(st.text(alphabet=list("abé \t\n \U0001f600"), max_size=60))
def test_words(text):
    data = text.encode()
    own = data.split()
    x, starts, ends = words.word_spans(data)
    assert [bytes(x[a:b]) for a, b in zip(starts, ends, strict=True)] == own
    hashes = words.word_hashes(data)
    assert all((hashes[i] == hashes[j]) == (own[i] == own[j]) for i in range(len(own)) for j in range(len(own)))
    two = words.grams(hashes, 2)
    pairs = list(zip(own, own[1:], strict=False))
    assert all((two[i] == two[j]) == (pairs[i] == pairs[j]) for i in range(len(pairs)) for j in range(len(pairs)))


@settings(max_examples=60)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 4), st.integers(0, 6))
def test_anchors(seq, gram, more):
    window = gram + more
    own = np.array([words.mix(np.array([s], np.uint64))[0] for s in seq], np.uint64)
    f, place, first, last = substring_dedup.anchors(own, window, gram)
    g, n = words.grams(own, gram), len(own) - window + 1
    covered = [(i, int(p)) for p, a, b in zip(place, first, last, strict=True) for i in range(a, b + 1)]
    assert [i for i, _ in covered] == list(range(max(0, n)))
    low = g & ~substring_dedup.PLACE
    for i, p in covered:
        assert i <= p <= i + window - gram and low[p] == low[i : i + window - gram + 1].min()
    assert all(f[k] == g[place[k]] for k in range(len(f)))


@pytest.mark.parametrize("group_rows", [2, 1000])
def test_repeats(spark, group_rows):
    rng = random.Random(group_rows)
    docs = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 40))) for _ in range(40)] + ["x y z w v u"] * 30
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["kept"]) for r in substring_dedup.remove_repeats(df, window=5, gram=2, group_rows=group_rows, text=True).collect()}
    seen = {}
    for d in docs:
        w = d.split()
        for i in range(len(w) - 4):
            seen[tuple(w[i : i + 5])] = seen.get(tuple(w[i : i + 5]), 0) + 1
    for k, d in enumerate(docs):
        w = d.split()
        keep = [True] * len(w)
        for i in range(len(w) - 4):
            if seen[tuple(w[i : i + 5])] > 1:
                keep[i : i + 5] = [False] * 5
        assert got[k] == (keep.count(False), " ".join(x for x, y in zip(w, keep, strict=True) if y))


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(500, 501 + i) for i in range(50)]
    parent = list(range(600))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {x: find(x) for e in edges for x in e if find(x) != x}


def test_near_copies(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(500)]
    docs = []
    for _ in range(30):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 120))]
        for _ in range(rng.randint(1, 12)):
            docs.append(" ".join(rng.choice(vocabulary) if rng.random() < rng.choice([0, 0.02, 0.05, 0.1]) else w for w in base))
    docs += ["same " * 20 + f"tail{i % 2}" for i in range(150)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    for n, region in ((2, 96), (2, 8), (5, 96)):
        sets = [{tuple(d.split()[i : i + n]) for i in range(len(d.split()) - n + 1)} for d in docs]
        parent = list(range(len(docs)))

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for i in range(len(docs)):
            for j in range(i):
                both = len(sets[i] & sets[j])
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = find(i), find(j)
                    parent[max(a, b)] = min(a, b)
        got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_dedup(df, words=n, region=region).collect()}
        wrong = [i for i in got if got[i] != find(i)]
        assert len(wrong) <= (0 if region == 96 else 3)  # small regions leave more to chance


def test_links_within_a_dense_mass(spark):
    """Some thousands of texts alike just below the threshold, and among them pairs just above it, far apart by id."""
    rng = random.Random(4)
    template, docs, fresh = [f"t{i}" for i in range(96)], [], iter(range(10**6))
    new = lambda n: [f"n{next(fresh)}" for _ in range(n)]
    for _ in range(3000):
        docs.append(template + new(16))  # 96 of 128: 0.75
    for i in range(40):
        own = new(11)
        docs[i * 7], docs[2999 - i * 11] = template + own + new(13), template + own + new(13)  # 107 of 133: 0.804
    for i in (3, 1001, 1999, 2995):
        docs[i] = template + new(12)  # 96 of 120: exactly 0.8 to each other, and they share no word but the template's
    words_of = [" ".join(rng.sample(d, len(d))) for d in docs]
    sets = [set(d) for d in docs]
    at = {w: k for k, w in enumerate(sorted(set().union(*sets)))}
    has = np.zeros((len(docs), len(at)), np.float32)
    for i, own in enumerate(sets):
        has[i, [at[w] for w in own]] = 1
    both, size = (has @ has.T).astype(int), np.array([len(s) for s in sets])
    linked = np.argwhere(np.triu(100 * both >= 80 * (size[:, None] + size[None, :] - both), 1))
    want = {}
    for a, b in linked.tolist():
        want.setdefault(b, want.get(a, a))
    assert len(linked) == 46
    df = spark.createDataFrame(list(enumerate(words_of)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_dedup(df, words=1).collect()}
    assert got == {i: want.get(i, i) for i in range(len(docs))}


def test_all_that_may_be_near_is_asked(spark):
    """A spanning edge may be refused on the full sets, so it must not stand for the pairs it joins."""
    row = lambda i, sig: ((i, 0, i), 100, bytearray(sig), bytearray(4 * 8 * 16), i)
    rows = [*(row(i, bytes(128)) for i in range(3)), row(3, bytes(80) + b"x" * 48)]  # 80 of 128: a pair at 0.8 can be so low
    df = spark.createDataFrame(rows, f"id {near_dedup.ID}, n long, sig binary, paths binary, known long")
    got = near_dedup.candidates(df, which=range(16), near=True, depth=8, region=96, threshold=0.8, whole=3, scratch=Scratch(spark, "t"), name="met").collect()
    assert {(r["a"]["d"], r["b"]["d"]) for r in got} == {(a, b) for b in range(4) for a in range(b)}


def test_common_counts():
    rng = np.random.default_rng(6)
    sets = [np.unique(np.concatenate([rng.integers(0, 40, 30), rng.integers(40, 3000, 60)])) for _ in range(150)]
    got = near_dedup._common(np.concatenate(sets), np.repeat(np.arange(150), [len(s) for s in sets]), 150)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(150) for j in range(150) if i != j)


@settings(max_examples=30)
@given(st.lists(st.integers(0, 5000), max_size=40), st.sampled_from([8, 64, 2048]))
def test_packer_fills(lengths, capacity):
    packer, out = packing.Packer(capacity, 7 << 40), []
    for i, n in enumerate(lengths):
        out += packer.add(i, np.arange(n, dtype="<u4"))
    out += packer.end()
    by_seq, by_doc = {}, {}
    for doc, start, length, crc, n, seq, offset in out:
        by_seq.setdefault(seq, []).append((offset, length))
        by_doc.setdefault(doc, []).append((start, length, n))
        assert crc == zlib.crc32(np.arange(start, start + length, dtype="<u4").tobytes())
    for own in by_seq.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]
        total = sum(n for _, n in own)
        assert total <= capacity and total & (total - 1) == 0
    for i, n in enumerate(lengths):
        own = sorted(by_doc.get(i, []))
        assert [s for s, _, _ in own] == [sum(n for _, n, _ in own[:k]) for k in range(len(own))] and sum(k for _, k, _ in own) == n
    assert sum(1 for own in by_seq.values() if sum(n for _, n in own) < capacity) <= capacity.bit_length()


def test_word_ids():
    from tokenizers import Tokenizer

    plain, own = Tokenizer.from_file(tokenizer_path()), packing.WordIds(tokenizer_path())
    rng = random.Random(2)
    letters = [*"abzÉéß'’\"-_.,!?#$%&*:;|0189½ \t\nñÀΣ中\U0001f600̧́ ​×÷", "'s", "'LL", " The ", "don't,", "naïve!!"]
    for _ in range(4000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 14)))
        assert own.of(text.encode()).tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_packing_query(spark):
    from tokenizers import Tokenizer

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    plain, by_doc = Tokenizer.from_file(tokenizer_path()), {}
    for r in queries()["op6_harmonic_packing"](spark, SF).collect():
        by_doc.setdefault(r["doc_id"], []).append(r)
    by_sequence = {}
    for r in (r for own in by_doc.values() for r in own):
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by_sequence.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]
        total = sum(n for _, n in own)
        assert total == 2048 or total < 2048 and total & (total - 1) == 0
    assert set(by_doc) == set(docs)
    for i, own in by_doc.items():
        ids = np.array([*plain.encode(docs[i] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids)) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)


def test_trigrams_have_8192_places():
    from helixsieve.llm import langid

    own = [f"{a}{b}" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"]
    counts = langid.trigram_counts(" ".join(own))
    assert len(counts) == 8192 and counts[4096:].any()


def test_held_out_languages(spark):
    docs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries()["op1_language_id"](spark, SF).collect()
    assert len(rows) == len(docs)
    held = [r for r in rows if r["held_out"]]
    assert held and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert sum(r["lang_pred"] == docs[r["doc_id"]] for r in held if docs[r["doc_id"]]) >= 0.97 * len(held)


def test_shards_are_near_equal(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries()["op8_histogram_sort"](spark, SF).collect()
    sizes = [0] * 40
    for r in rows:
        data = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 16, zlib.crc32(data))
        sizes[r["shard"]] += r["size"]
    mean, most = sum(sizes) / 40, max(r["size"] for r in rows)
    assert len(rows) == len(docs) and all(abs(s - mean) <= most for s in sizes)
    for s in range(40):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))


@given(st.lists(st.tuples(st.integers(0, 50), st.integers(1, 3)), max_size=6), st.integers(1, 200))
def test_cut_time(sources, percent):
    budget = Fraction(percent, 100) * sum(s for s, _ in sources)
    t = mixing.cut_time(sources, budget, 2)
    assert sum(min(Fraction(2 * s), w * t) for s, w in sources) == budget


def test_mix_reruns_agree(spark):
    run = lambda: sorted((r["doc_id"], r["taken"]) for r in queries()["op9_fair_queueing"](spark, SF).collect())
    assert run() == run()


def test_splitters_on_a_hot_key(spark):
    rows = [(i, "hot" if i % 3 else f"t{i}") for i in range(900)]
    out = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), shards=7).collect()
    sizes = [sum(r["size"] for r in out if r["shard"] == s) for s in range(7)]
    assert max(sizes) - min(sizes) <= 2 * 21


@pytest.mark.parametrize("seed", range(3))
def test_ball_tree(seed):
    rng = np.random.default_rng(seed)
    x = np.floor(64 * rng.normal(size=(700, 12)) * rng.choice([0.01, 1], size=(700, 1)))
    x[100:400] = x[100]
    ids = rng.permutation(5000)[:700]
    tree = topk.BallTree.load(topk.BallTree.build(ids, x).dump())
    inner = [n for n in tree.nodes.tolist() if n[2]]
    assert inner and all(tree.nodes[c][0] == a and tree.nodes[c + 1][1] == b for a, b, c in inner)
    for (a, b, _), centre, radius in zip(tree.nodes.tolist(), tree.centres, tree.radii, strict=True):
        assert np.sqrt(((tree.x[a:b] - centre) ** 2).sum(1)).max() <= radius + 1e-9
    got = topk.search(tree, ids[:50], x[:50], 10, [None] * 50)
    for i in range(50):
        want = sorted((-int(s), int(v)) for s, v in zip(x @ x[i], ids, strict=True) if v != ids[i])[:10]
        assert got[i] == [(-s, v) for s, v in want]
        floor = got[i][4][0]  # what ties with a floor is kept
        assert topk.search(tree, ids[i : i + 1], x[i : i + 1], 10, [floor])[0][:5] == got[i][:5]


def test_scores_beyond_64_bits():
    for score in (0, -5, (1 << 63) - 1, 1 << 63, 1 << 70, -(1 << 63), -(1 << 70)):
        assert topk._join(*topk._split(score)) == score
    order = [topk._split(s) for s in (-(1 << 80), -(1 << 70), -(1 << 63), -7, 0, (1 << 63) - 2, (1 << 63) - 1, 1 << 63, 1 << 80)]
    assert order == sorted(order)


def test_arc(spark, tmp_path):
    own = [("http://a/%20b", "20200102030405", "text/html", b"HTTP/1.1 200 OK\r\nX-Page-Id: 7\r\nContent-Length: 23\r\n\r\nbody\n\nhttp://x 1 2 3 4\n"), ("dns:a", "20200102030405", "text/dns", b""), ("http://big/", "20200102030406", "text/plain", b"z" * (17 << 20))]
    (tmp_path / "arc").mkdir()
    for version in (1, 2):
        data = warc.arc_begin(version, "x.arc") + b"".join(warc.arc_record(version, "x.arc", 0, *x) for x in own)
        got = list(warc.arc_records(data))
        assert [b for _, b in got] == [x[3] for x in own] and [h["URL"] for h, _ in got] == [x[0] for x in own]
        assert list(got[0][0]) == warc.ARC_FIELDS[version].split()
        row = warc.to_warc(*got[0], "k")
        assert (row[6], row[3], row[5], row[9]) == (7, "2020-01-02T03:04:05Z", "response", 23)
        assert warc.to_warc(*got[1], "k")[4:6] == ("text/dns", "resource")
        with pytest.raises(ValueError):
            list(warc.arc_records(data[:-60]))
        (tmp_path / "arc" / f"v{version}.arc").write_bytes(data)  # as others write them, not compressed
    scratch = Scratch(spark, "t")
    warc.convert_arc(spark, str(tmp_path / "arc"), scratch.path("warc"), scratch=scratch)
    rows = warc.read_warc(spark, scratch.path("warc")).collect()
    assert sorted((r["payload_bytes"], r["record_type"]) for r in rows) == [(0, "resource"), (0, "revisit"), (23, "response"), (23, "revisit"), (17 << 20, "resource"), (17 << 20, "revisit")]


def test_gzip_members():
    import gzip

    for data in (b"", b"abc" * 1000, bytes(range(256)) * (70 << 10)):
        assert gzip.decompress(warc.member(data) + b"\0") == data
    assert gzip.decompress(b"".join(warc.member(x) + b"\0" for x in (b"a", b"b"))) == b"ab"


def test_equal_rows_are_dealt_out(spark):
    rows = sharding.shard_by_bytes(spark.createDataFrame([(1, "abc")] * 400, "doc_id long, text string"), shards=8).collect()
    sizes = [sum(r["shard"] == s for r in rows) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1


def test_slots_are_in_key_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    rows = sorted(sharding.shard_by_bytes(docs, shards=5).collect(), key=lambda r: (r["shard"], r["slot"]))
    keys = [(hashlib.md5(text[r["doc_id"]].encode()).hexdigest(), r["doc_id"]) for r in rows]
    assert keys == sorted(keys)


def test_cut_along_the_order(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice(["a", "b", "c", "d", None]), " ".join(["w"] * rng.choice([0, 1, 5, 40, 700])) + " " * i) for i in range(300)]
    rows += [(1000, "lone", "x")]
    own = {}
    for _, source, text in rows:
        own[source] = own.get(source, 0) + len(text.split())
    names = sorted((n for n in own if n), key=lambda n: n.encode()) + [None]
    weight = {n: (3, 1, 2)[i % 3] for i, n in enumerate(names)}
    t = mixing.cut_time([(own[n], weight[n]) for n in names], Fraction(3, 2) * sum(own.values()), 2)
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    for n in names:
        quota, mine = min(Fraction(2 * own[n]), weight[n] * t), [r for r in got if r["source"] == n]
        assert {r["target"] for r in mine} == {float(quota)} and sum(r["taken"] for r in mine) == int(quota)
        queue = sorted(mine, key=lambda r: hashlib.md5(f"17|{r['doc_id']}|{rows[r['doc_id']][2] if r['doc_id'] < 1000 else 'x'}".encode()).hexdigest())
        upto = 0
        for r in queue:
            assert r["taken"] == sum(max(0, min(r["size"], int(quota) - k * own[n] - upto)) for k in (0, 1))
            upto += r["size"]


def test_classes_take_their_count():
    packer = packing.Packer(64, 0, gaps=1000)
    for i in range(6):  # class 3: 17 to 21 of 64
        packer.add(i, np.arange(21, dtype="<u4"))
    assert [len(pieces) for _, _, pieces in packer.gaps] == [3, 3] and not packer.waiting
    rows = packer.add(9, np.arange(1, dtype="<u4")) + packer.end()  # the last fills a gap
    assert {r[0] for r in rows} == {*range(6), 9} and sum(r[2] for r in rows) == 127
    rng = random.Random(1)
    packer, out = packing.Packer(2048, 0), []
    for i in range(3000):
        out += packer.add(i, np.arange(int(rng.lognormvariate(5.5, 1)) % 2048 + 1, dtype="<u4"))
    assert len(out + packer.end()) < 1.4 * 3000  # most documents are whole


def test_other_tokenizers():
    import public_tokenizers
    from tokenizers import Tokenizer

    for name, special in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        path = public_tokenizers.path(name)
        assert packing.by_word(path) == special
        plain, own = Tokenizer.from_file(path), packing.encoder(path)
        for text in ("Hello  <|endoftext|> the WORLD's", "a<|ENDOFTEXT|>b", "", "naïve  ½ \n x"):
            assert own(text.encode()).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_chunks_hashed_apart(spark):
    docs = spark.createDataFrame([(i, ("ab c" * i)[: 7 * (i % 9)]) for i in range(40)] + [(99, None)], "doc_id long, text string")
    run = lambda spread: sorted(map(str, exact_dedup.exact_dedup(docs, spread=spread).drop("uid").collect()))
    assert run(5) == run(1 << 20)


def test_shrinkage_by_hand(spark):
    """Hosts of one domain and suffix; every step of the shrinkage in plain Python."""
    rows = [("a.x.org", 10, 9), ("b.x.org", 10, 1), ("c.x.org", 0, 0), ("y.org", 4, 2), ("z.com", 5, 0), ("1.2.3.4", 3, 3)]
    got = {r["host"]: r for r in url_reputation.host_reputation(spark.createDataFrame(rows, "host string, n long, b long"), z=1.645, cut=0.5).collect()}

    def strength(level):
        own = [(n, b) for n, b in level if n]
        k, n, b = len(own), sum(n for n, _ in own), sum(b for _, b in own)
        m = b / n
        rho = ((sum(b * b / n for n, b in own) - n * m * m) / k - m * (1 - m)) / (m * (1 - m) * (n / k - 1))
        return max(1.0, min(1000.0, 1 / rho - 1)) if rho > 0 else 1000.0

    suffix = {"org": (24, 12), "com": (5, 0), "1.2.3.4": (3, 3)}
    domain = {"x.org": (20, 10), "y.org": (4, 2), "z.com": (5, 0), "1.2.3.4": (3, 3)}
    ks, kd, kh = strength(suffix.values()), strength(domain.values()), strength([(n, b) for _, n, b in rows])
    overall = (15 + 1) / (32 + 10)
    for host, n, b in rows:
        d = host if host[0].isdigit() else ".".join(host.split(".")[-2:])
        s = host if host[0].isdigit() else host.split(".")[-1]
        rate = (suffix[s][1] + ks * overall) / (suffix[s][0] + ks)
        rate = (domain[d][1] + kd * rate) / (domain[d][0] + kd)
        rate = (b + kh * rate) / (n + kh)
        assert got[host]["rate"] == pytest.approx(rate) and got[host]["bound"] == pytest.approx(rate - 1.645 * (rate * (1 - rate) / (n + kh + 1)) ** 0.5)


def test_batches_of_languages(spark):
    """The batch's product against plain sums, a text and a pair at a time."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model, texts = langid.fit(docs), [r["text"] for r in docs.limit(60).collect()] + [None, "", "123"]
    margin = lambda x, i: float(sum(float(a) * float(b) for a, b in zip(x, model.weights[i], strict=True) if a) + model.offsets[i])
    for text, (lang, score) in zip(texts, model.predict(texts, batch=7), strict=True):
        if not text or not any(c.isalpha() for c in text):
            assert (lang, score) == ("und", 0.0)
            continue
        x = langid.unit(langid.trigram_counts(text))
        first = [margin(x, i) for i in range(len(model.families))] if len(model.families) > 1 else [0.0]
        own = model.own[model.families[first.index(max(first))]]
        wins = {v: 0 for v in own}
        for k, (a, b) in enumerate(model.pairs):
            if a in wins:
                wins[a if margin(x, (len(model.families) if len(model.families) > 1 else 0) + k) > 0 else b] += 1
        assert wins[lang] == max(wins.values()) and 0 <= score <= 1


def test_regions_across_tasks(spark):
    """Neighbours meet although every task holds a few rows only."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    docs = []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(60)]
        docs += [" ".join(base[:-k] + [f"x{rng.random()}"] * k if k else base) for k in range(4)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    run = lambda: sorted((r["doc_id"], r["component_id"]) for r in near_dedup.near_dedup(df, words=2, trees=4, first_trees=1).collect())
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        one = run()
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        assert run() == one
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_pipeline_from_end_to_end(spark, tmp_path):
    """Every stage in plain Python, against the rows of run()."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    rng = random.Random(12)
    stems = {"en": "the of and that with this for there which from".split(), "de": "der die und nicht mit sich auch einer wird von".split()}
    rows = []
    for i in range(60):
        lang = rng.choice(["en", "de"])
        words_ = [rng.choice(stems[lang]) + rng.choice(["", f" {lang}{rng.randint(0, 30)}"]) for _ in range(rng.randint(20, 60))]
        rows.append((i, " ".join(words_), lang, rng.choice(["s1", "s2", None]), 0))
    rows += [(100 + i, rows[i][1].replace(" ", "  ") + " ", rows[i][2], "s1", 0) for i in range(10)]  # equal but for white space
    rows += [(200 + i, rows[20 + i][1] + " tail", rows[20 + i][2], "s3", 0) for i in range(10)]  # near copies
    rows += [(300, None, "en", "s1", 0), (301, "123 456", None, "s2", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))

    docs = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    best = {}
    for r in docs:
        key = "".join(r[1].split())
        best[key] = min(best.get(key, r), r, key=lambda r: (-len(r[1]), r[0]))
    docs = sorted(best.values())
    sets = [{tuple(r[1].split()[i : i + 5]) for i in range(len(r[1].split()) - 4)} for r in docs]
    kept, root = [], list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root = [root[j] if x == root[i] else x for x in root] if root[j] < root[i] else [root[i] if x == root[j] else x for x in root]
    kept = [r for i, r in enumerate(docs) if root[i] == i]
    own = {}
    for r in kept:
        own[r[3]] = own.get(r[3], 0) + len(r[1].split())
    names = sorted(n for n in own if n) + [None] * (None in own)
    weight = {n: (3, 1, 2)[i % 3] for i, n in enumerate(names)}
    t = mixing.cut_time([(own[n], weight[n]) for n in names], Fraction(3, 2) * sum(own.values()), 2)
    plain, want = Tokenizer.from_file(tokenizer_path()), []
    for n in names:
        quota, upto = int(min(Fraction(2 * own[n]), weight[n] * t)), 0
        for r in sorted((r for r in kept if r[3] == n), key=lambda r: hashlib.md5(f"17|{r[0]}|{r[1]}".encode()).hexdigest()):
            size = len(r[1].split())
            for k in (0, 1):
                part = max(0, min(size, quota - k * own[n] - upto))
                if part:
                    want.append((r[0], len(plain.encode(" ".join(r[1].split()[:part]), add_special_tokens=False).ids) + 1))
            upto += size
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["doc_tokens"]) for r in got if r["start"] == 0) == sorted(want)
    assert sum(r["length"] for r in got) == sum(n for _, n in want)
