"""Each operator's query over tables with edge cases, against brute force, round trips or held-out accuracy."""

import functools
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tessera.llm import components, decontaminate, labelled, language_id, near, quality, queries, sentencepiece_codec, sharding, simhash, sketch, textbytes, token_files, toxicity, warc, wordmemory


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables_give_empty_results(spark, empty_sf, name):
    assert queries.QUERIES[name](spark, empty_sf).count() == 0


def test_op1_language(spark, sf, docs):
    got = language_id.op1(spark, sf).collect()
    assert len(got) == len(docs)
    truth = {d.doc_id: d.lang for d in docs if d.doc_id is not None and d.doc_id < 1000}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    by = {r.doc_id: r for r in got}
    for i in (1000, 1001, 1002, 1003):
        assert (by[i].lang_pred, by[i].score) == ("und", 0.0)
    assert by[1008].lang_pred != "und" and all(0 <= r.score <= 1 for r in got)


def test_op1_families_and_single_language():
    assert language_id.family_of("de-AT") == "germanic" and language_id.family_of("xx") == "own:xx"
    m = language_id.Model(["germanic"], {"germanic": ["en"]}, np.zeros((language_id.DIM, 1), np.float32), np.zeros(1, np.float32), [])
    assert m.predict(np.zeros((2, language_id.DIM), np.float32))[0].tolist() == ["en", "en"]


def test_op2_archives(spark, sf):
    got = [tuple(r) for r in warc.op2(spark, sf).collect()]
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    first = {}
    for p in pages:
        if p.page_id is not None:
            first[p.html or ""] = min(first.get(p.html or "", p.page_id), p.page_id)
    want = []
    for p in pages:
        h = (p.html or "").encode()
        own = first[p.html or ""] == p.page_id
        want.append((p.page_id, len(h), warc.digest(h), "response" if own else "revisit", None if own else first[p.html or ""]))
    assert Counter(got) == Counter(want)


def test_op2_random_access(tmp_path):
    records = {i: (f"<b>{i}</b>" * (i * 40_000)).encode() for i in range(6)}
    with open(tmp_path / "a", "wb") as f:
        w = warc.BundleWriter(f)
        for i, p in records.items():
            w.add(warc.record_name(i), warc.record(i, "http://x/", p, None, "2020-01-01T00:00:00Z"))
        w.close()
    with open(tmp_path / "a", "rb") as f:
        r = warc.BundleReader(f)
        assert len(r.places) > 2
        for i, p in records.items():
            ((head, block),) = r.read(warc.record_name(i))
            assert block.partition(b"\r\n\r\n")[2] == p and head["warc-payload-digest"] == "sha1:" + warc.digest(p)
    import io

    import zstandard

    raw = (tmp_path / "a").read_bytes()  # any reader that skips skippable frames unpacks the records
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
    assert plain.startswith(b"WARC/1.1") and plain.count(b"WARC-Record-ID") == 6


def test_op3_toxicity(spark, sf, docs):
    got = toxicity.op3(spark, sf).collect()
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.toxic is not None}
    assert len(got) == len(docs)
    rows = [r for r in got if r.doc_id in truth and r.doc_id is not None]
    held = [r for r in rows if r.held_out]
    assert len(held) > 30 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.9 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert len({r.score for r in got if r.doc_id in (1000, 1001, 1002)}) == 1


def brute_kneser_ney(texts, labels):
    """P(byte | bytes before it in the word) of both classes by the textbook formulas, over dictionaries; a function of (class, n-gram)."""
    from collections import defaultdict

    def grams(t):
        for w in re.findall(rb"[a-z\x80-\xff]+", lower(t).encode()):
            w = b" " + w + b" "
            for i in range(1, len(w)):
                yield w[max(0, i - 7) : i + 1]

    c = [Counter(), Counter()]
    for t, y in zip(texts, labels):
        c[y].update(grams(t))
    every = set(c[0]) | set(c[1])
    d = []
    for n in c:
        one, two = (sum(v == k for v in n.values()) for k in (1, 2))
        d.append(one / (one + 2 * two) if one else 0.5)
    kept = {g for g in every if c[0][g] + c[1][g] >= 3}
    contexts = defaultdict(set)
    for g in every:
        contexts[g[-4:]].add(g[:-1])
    after = defaultdict(list)
    for s, ctx in contexts.items():
        after[s[:-1]].append(len(ctx))

    def base(s):
        own = after[s[:-1]]
        return max(len(contexts[s]) - 0.75, 0) / sum(own) + 0.75 * len(own) / sum(own) / 256

    def left(k, ctx):
        total = sum(n for g, n in c[k].items() if g[:-1] == ctx)
        own = sum(max(c[k][g] - d[k], 0) for g in kept if g[:-1] == ctx)
        return max(1 - own / total, 1e-3) if total else 1.0

    def p(k, g):
        total = sum(n for h, n in c[k].items() if h[:-1] == g[:-1])
        return (max(c[k][g] - d[k], 0) / total if total else 0) + left(k, g[:-1]) * base(g[-4:])

    return {g: np.log(p(1, g) / p(0, g)) for g in kept}, {g[:-1]: np.log(left(1, g[:-1]) / left(0, g[:-1])) for g in kept}, grams


def test_op3_against_plain_kneser_ney(spark):
    import random

    rng = random.Random(4)
    texts = [" ".join(rng.choice(["the", "Then", "ab", "abba", "über", "stupidly", "x", "internationally"]) for _ in range(rng.randint(0, 9))) for _ in range(40)] + [None, "", "12 !"]
    labels = [i % 3 // 2 for i in range(len(texts))]
    want, contexts, grams = brute_kneser_ney(texts, labels)
    rows = spark.createDataFrame(list(zip(texts, labels)), "text string, _label int")
    name = lambda k: (k & (2**64 - 1)).to_bytes(8, "big").lstrip(b"\0")
    model = toxicity.fit(toxicity.count(rows, "text", "_label"))
    got = model.entries.collect()
    assert {name(r.key): pytest.approx(r.llr, abs=1e-5) for r in got if not r.context} == want
    assert {name(r.key): pytest.approx(r.llr, abs=1e-5) for r in got if r.context} == contexts
    # whole texts, by both ways of looking up
    for most in (None, 0):
        model = toxicity.fit(toxicity.count(rows, "text", "_label"), most)
        found = toxicity.annotate_ratios(rows.select("text"), model, "text", None, ["mean", "root"], lambda mean, root: [mean, root]).collect()
        assert len(found) == len(texts)
        for r in found:
            words = re.findall(rb"[a-z\x80-\xff]+", lower(r.text).encode())
            ratio = [sum(want.get(g, contexts.get(g[:-1], 0.0)) for g in grams(w.decode())) for w in words]
            total = sum(np.log(0.99 + 0.01 * np.exp(x)) for x in ratio)
            assert r["mean"] == pytest.approx(total / max(len(words), 1), abs=1e-4) and r["root"] == pytest.approx(total / max(len(words), 1) ** 0.5, abs=1e-4)


def test_op3_both_ways_score_alike(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scores = []
    for most in (None, 0):
        model = toxicity.train(docs, labels, most=most)
        assert (model.table is None) == (most == 0)
        scores.append(sorted((r.text or "", r.s) for r in toxicity.score(docs, model, keep=["text"], out="s").collect()))
    assert [t for t, _ in scores[0]] == [t for t, _ in scores[1]]
    assert np.allclose([s for _, s in scores[0]], [s for _, s in scores[1]], atol=1e-6)


@pytest.mark.parametrize("others", [200, 20_000])
def test_op3_rare_expressions_count_at_every_size(spark, others):
    """What three toxic texts say and no ordinary one has an entry, and counts for toxic, however many texts there are."""
    rows = [(f"some words of text number {i} here", 0) for i in range(others)] + [(f"you zqxwvian {i}", 1) for i in range(3)] + [("some words here", 1)] * 20
    model = toxicity.fit(toxicity.count(spark.createDataFrame(rows, "text string, _label int"), "text", "_label"))
    text = textbytes.column_bytes(pa.array(["zqxwvian"]))
    table = model.table.value
    assert np.isin(toxicity.keys_of(toxicity.grams_of(*text).gram, False), table.key).all()
    assert toxicity.evidence(*text, table)[0][0] > 5


def test_op3_counts_cover_all_rows(spark):
    rows = spark.createDataFrame([("ab ab", 1), ("ab", 0), (None, 0), ("", 1)], "text string, _label int")
    got = toxicity.count(rows, "text", "_label").collect()
    assert sorted((r.c1, r.c0) for r in got) == [(2, 1)] * 3  # a, b, end


def test_op3_long_texts_in_pieces():
    """A text beyond a slice is worked on in pieces that cut no word, with the same n-grams."""
    text = ("wörd another " * 400_000).encode()
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    parts = list(textbytes.pieces(data, offsets, textbytes.LETTER_BYTES))
    assert len(parts) > 2 and b"".join(p.tobytes() for p, _ in parts) == text
    whole = toxicity.grams_of(data, offsets)
    assert np.concatenate([toxicity.grams_of(*p).gram for p in parts]).tolist() == whole.gram.tolist()


def test_op5_quality(spark, sf, docs):
    got = quality.op5(spark, sf).collect()
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.quality is not None}
    assert len(got) == len(docs)
    held = [r for r in got if r.held_out and r.doc_id in truth and r.doc_id is not None]
    assert len(held) > 30 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.9 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.score == 0 for r in got if r.doc_id in (1000, 1001, 1002))


def test_op5_marginals_against_enumeration():
    rng = np.random.default_rng(0)
    m = quality.Model(rng.normal(size=quality.WIDTH), rng.normal(size=(2, 2)))
    x = rng.normal(size=(7, quality.WIDTH))
    first = np.array([0, 4, 4, 7])
    got = m.marginals(x, first)
    emit = x @ m.weights
    for a, b in ((0, 4), (4, 7)):
        n = b - a
        total, good = 0.0, np.zeros(n)
        for code in range(1 << n):
            y = [code >> i & 1 for i in range(n)]
            p = np.exp(sum(emit[a + i] for i in range(n) if y[i]) + sum(m.trans[y[i], y[i + 1]] for i in range(n - 1)))
            total += p
            good += p * np.array(y)
        assert np.allclose(got[a:b], good / total)


def brute_simhash(t):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", lower(t)) if x]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def test_op4_components(spark, sf, docs):
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.op4(spark, sf).collect())
    fps = [brute_simhash(d.text) for d in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4 and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, d in enumerate(docs):
        if d.doc_id is not None:
            least[find(i)] = min(least.get(find(i), d.doc_id), d.doc_id)
    assert got == Counter((d.doc_id, f"{fps[i]:016x}", least.get(find(i))) for i, d in enumerate(docs))


def test_op4_forest_and_hot_shards(spark, monkeypatch):
    rng = np.random.default_rng(3)
    center = int(rng.integers(1 << 62))
    near = {center}
    while len(near) < 300:
        near.add(center ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))))
    far = {int(x) for x in rng.integers(1 << 62, size=200)}
    fps = sorted(near | far)
    linked = lambda edges: len({frozenset(c) for c in _groups(fps, edges)})
    brute = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 4]
    assert linked(simhash.forest(fps)) == linked(brute) and len(simhash.forest(fps)) < len(fps)
    monkeypatch.setattr(simhash, "HOT", 64)
    signed = lambda x: int(np.uint64(x).view(np.int64))
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    edges = [(int(np.int64(r.a).view(np.uint64)), int(np.int64(r.b).view(np.uint64))) for r in simhash.links(df).collect()]
    assert linked(edges) == linked(brute)


@pytest.mark.parametrize("seed", [1, 2])
def test_op4_hot_shards_of_several_groups(spark, monkeypatch, seed):
    """Groups that share shards, hang together by chains or not at all, and members outside the largest group, against brute force."""
    rng = np.random.default_rng(seed)
    flip = lambda x, bits: x ^ sum(1 << int(b) for b in rng.choice(24, bits, replace=False))
    base = int(rng.integers(1 << 62)) & ~0xFFFFFF
    fps, centers = set(), [base, base | 0x7F, base | 0xFFF000]
    for c in centers:
        chain = c
        for _ in range(25):
            chain = flip(chain, int(rng.integers(1, 6)))
            fps |= {chain, flip(chain, 2), flip(c, int(rng.integers(2, 9)))}
    fps = sorted(fps)
    brute = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 4]
    want = {frozenset(c) for c in _groups(fps, brute)}
    assert len(want) > 1
    for hot in (8, 40, 4096):
        monkeypatch.setattr(simhash, "HOT", hot)
        df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps], "fp long")
        edges = [(int(np.int64(r.a).view(np.uint64)), int(np.int64(r.b).view(np.uint64))) for r in simhash.links(df).collect()]
        assert {frozenset(c) for c in _groups(fps, edges)} == want


def test_joins_on_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(components, "HOT_ROWS", 0)
    monkeypatch.setattr(components, "HOT_SHARE", 10)
    left = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(300)] + [(None, -1)], "k int, v int")
    right = spark.createDataFrame([(k, f"r{k}") for k in range(0, 300, 2)] + [(1, "one")], "k int, w string")
    want = Counter(map(tuple, left.join(right, "k").collect()))
    assert Counter(map(tuple, components.join_hot(left, right, "k").collect())) == want
    chain = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 60)]
    got = {r.a: r.b for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 31)} | {100 + i: 100 for i in range(1, 60)}


def _groups(nodes, edges):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        root[find(a)] = find(b)
    out = {}
    for n in nodes:
        out.setdefault(find(n), set()).add(n)
    return out.values()


def test_op4_bk_tree_finds_all():
    rng = np.random.default_rng(1)
    fps = sorted({int(x) & 0xFFF for x in rng.integers(1 << 62, size=300)})
    tree = simhash.BKTree(fps)
    for q in fps[::17]:
        assert {fps[i] for i in tree.within(q, 2)} == {f for f in fps if (f ^ q).bit_count() <= 2}
    pairs = {(at, int(j)) for at, near in tree.batch(np.array(fps, np.uint64), 2) for j in near}
    assert pairs == {(i, j) for i, a in enumerate(fps) for j, b in enumerate(fps) if (a ^ b).bit_count() <= 2}


def test_op6_shards(spark, sf, docs):
    got = sharding.op6(spark, sf).collect()
    assert len(got) == len(docs) and {r.law for r in got} == {"rows"} and all(r.grown_shard is None for r in got)
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(40)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    want = Counter((d.doc_id, len((d.text or "").encode()) + 16, zlib.crc32((d.text or "").encode())) for d in docs)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want


def test_op6_mixture(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"s{i % 4}") for i in range(1200)], "doc_id long, source string")
    got = sharding.interleave(rows, 10).collect()
    share = Counter(r.source for r in got)
    for shard in range(10):
        own = Counter(r.source for r in got if r.shard == shard)
        assert all(abs(own[s] - n / 10) <= 1.01 for s, n in share.items())


def test_op7_equals_the_library(spark, sf, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.model_path())
    want = Counter((d.doc_id, tuple(sp.encode(d.text or ""))) for d in docs)
    got = sentencepiece_codec.op7(spark, sf).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    text = {d.doc_id: d.text or "" for d in docs if d.doc_id is not None}
    for r in got:
        assert r.n_tokens == len(r.ids) and r.lossless
        if r.doc_id is not None:
            assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_op7_unusual_texts():
    import random

    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.model_path())
    rng, parts = random.Random(1), ["the", "a", "ing", " ", "   ", "\n", "\t", "12", "é", "中", "🙂", "<s>", "▁", "er", "AB", "_", "''", "\x00", "ж", "return", "    "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    c = sentencepiece_codec.Codec(sentencepiece_codec.model_path())
    assert coded(c, texts) == sp.encode(texts)
    ids = [sp.encode(t) for t in texts]
    at = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
    assert c.texts(*c.decode(np.concatenate(ids).astype(np.int64), at)).to_pylist() == [t.replace("▁", " ") for t in texts]


def coded(c, texts):
    """A codec's ids of texts, as lists."""
    ids, at = c.encode(*textbytes.column_bytes(pa.array(texts, pa.string())))
    return [ids[a:b].tolist() for a, b in zip(at, at[1:])]


def test_op7_bytes_that_are_no_text():
    c = sentencepiece_codec.Codec(sentencepiece_codec.model_path())
    ids = np.array([c.byte[0xE4], c.byte[0x41], c.byte[0xFF]])
    assert c.texts(*c.decode(ids, np.array([0, 1, 3, 3]))).to_pylist() == ["\ufffd", "A\ufffd", ""]


def test_op7_long_runs_and_long_texts():
    """Runs of marks of every length up to 150 and of a million, long words without a space, and a text beyond a slice, against the library."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.model_path())
    c = sentencepiece_codec.Codec(sentencepiece_codec.model_path())
    texts = [f"{a}{' ' * n}{b}" for n in range(150) for a, b in (("", ""), ("x", "y"), ("\n", "中"), ("é", "\t"))]
    texts += [" " * 10**6 + "end", "  " + "語" * 5000, "ab" * 40_000, "  " + "xyz" * 30_000, "\n" * 10**6]
    texts += ["some words of a long text, " * 120_000]
    assert len(texts[-1]) > textbytes.SLICE_BYTES
    assert coded(c, texts) == sp.encode(texts)


def test_op7_memory_that_starts_afresh(sf, docs):
    c, small = (sentencepiece_codec.Codec(sentencepiece_codec.model_path()) for _ in range(2))
    small.memory = wordmemory.WordMemory(64, 256)
    texts = [d.text for d in docs[:60]]
    assert coded(c, texts) == coded(small, texts) == coded(small, texts)


def test_word_names():
    """A word has one name wherever it stands, short or beyond what sums of powers name."""
    words = [b"a", b"ab", b"x" * 64, b"x" * 65, b"yz" * 400, b"\x00", b"\x00\x00"]
    rows = words + words[::-1]
    data = np.frombuffer(b"".join(rows), np.uint8)
    ends = np.cumsum([len(w) for w in rows])
    names = wordmemory.names(data, ends - [len(w) for w in rows], ends)
    assert len({*names.tolist()}) == len(words) and (names == names[::-1]).all()


def test_hashes_of_long_data():
    """Spans in data of several blocks have the hashes they have by themselves."""
    rng = np.random.default_rng(3)
    data = rng.integers(97, 123, 2 << 20).astype(np.uint8)
    starts = np.sort(rng.integers(0, len(data) - 50, 4000))
    ends = starts + rng.integers(0, 40, 4000)
    ends[7] = starts[7] + textbytes.HASH_BYTES + 9
    got = textbytes.span_hashes(data, starts, ends)
    for i in (0, 7, 8, 1999, 3999):
        own = data[starts[i] : ends[i]]
        assert got[i] == textbytes.span_hashes(own, np.array([0]), np.array([len(own)]))[0]


def test_op7_unigram_rule():
    """The Viterbi rule on a toy vocabulary, against enumerating every segmentation."""
    import itertools

    c = sentencepiece_codec.Codec.__new__(sentencepiece_codec.Codec)
    c.score = {"▁": -2.0, "a": -1.5, "b": -1.6, "ab": -2.0, "▁a": -2.2, "ba": -2.1, "▁ab": -4.5}
    c.ids, c.bpe, c.byte, c.unk = {p: i for i, p in enumerate(c.score)}, False, {}, 99
    c.ends = {}
    for p in c.score:
        for key in {p[-2:], p[-1]}:
            c.ends.setdefault(key, set()).update(len(x) for x in c.score if x.endswith(key) or x == key[-1])
    c.ends = {k: tuple(sorted(v, reverse=True)) for k, v in c.ends.items()}
    words = ["▁" + "".join(x) for n in range(1, 6) for x in itertools.product("ab", repeat=n)]
    order, flat, size = c.forward(words)
    assert sorted(order) == list(range(len(words)))
    for i, ids in zip(order, np.split(flat, np.cumsum(size)[:-1])):
        w, names = words[i], list(c.score)
        assert "".join(names[i] for i in ids) == w
        got = sum(c.score[names[i]] for i in ids)
        cuts = [(0, *mid, len(w)) for k in range(len(w)) for mid in itertools.combinations(range(1, len(w)), k)]
        parts = [[w[a:b] for a, b in itertools.pairwise(cut)] for cut in cuts]
        best = max(sum(c.score[p] for p in ps) for ps in parts if all(p in c.score for p in ps))
        assert got == pytest.approx(best)


def test_op8_files(spark, sf, docs):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(token_files.tokenizer_path())
    order = sorted(docs, key=lambda d: (d.doc_id is not None, d.doc_id or 0, int(np.uint64(xxhash.xxh64_intdigest((d.text or "").encode(), 42)).view(np.int64))))
    want, at = [], 0
    for d in order:
        ids = np.array([*tk.encode(d.text or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((d.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert Counter(tuple(r) for r in token_files.op8(spark, sf).collect()) == Counter(want)


def test_op8_wavelet_matrix():
    ids = (np.random.default_rng(0).zipf(1.2, 3000) % 700).astype(np.uint32)
    w = token_files.Shard(token_files.dump([1, None], np.array([1000, 2000]), ids)).matrix
    assert (w.ids() == ids).all() and all(w.access(i) == ids[i] for i in range(0, 3000, 37))
    for t in (1, 2, 7, 699, 10**6):
        places = np.flatnonzero(ids == t)
        assert w.count(t, 100, 2500) == ((places >= 100) & (places < 2500)).sum()
        assert [w.select(t, k) for k in (0, len(places) - 1) if 0 <= k < len(places)] == [int(places[k]) for k in (0, len(places) - 1) if 0 <= k < len(places)]
        assert w.select(t, len(places)) == -1
    for few in (np.zeros(0, np.uint32), np.full(5, 9, np.uint32)):
        assert (token_files.WaveletMatrix.build(few).ids() == few).all()


def test_op8_short_way_equals_the_library():
    import random

    e = token_files.Encoder(token_files.tokenizer_path())
    assert e.short
    rng, parts = random.Random(2), ["the", "THE", "'", "'s", "'LL", "''", "!'s", " ", "\n", "\t", "23", "é", "É", "中", "<|endoftext|>", "ß", "œ", "ª", "²", "İ", "ŉ", "\xa0", "\x1c", "\x85", "é", "ñ", "×", "_", "ſ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(4000)]
    plain = ["the ", "don't", "'re", "'", "''", "!'ll", "3", "½é", "É", "Ŧ", " ", "\n", "."]
    texts += ["".join(rng.choice(plain) for _ in range(rng.randint(0, 9))) for _ in range(4000)]
    want = [x.ids for x in e.library.encode_batch(texts, add_special_tokens=False)]
    data, offsets = textbytes.column_bytes(pa.array(texts, pa.string()))
    assert [x.tolist() for x in e.encode(data, offsets)] == want
    assert len(e.odd(data, offsets)) < len(texts) - 4000


def test_op8_rank_and_select_on_files(spark, tmp_path):
    """Occurrences of an id by the files' bit-planes, against a scan, with planes of several blocks and shards of several documents."""
    texts = ["rare " + "the of and " * 5, "", None, "the rare rare", "of " * 400_000 + "rare", "and"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    where = f"file://{tmp_path}/files"
    manifest = spark.createDataFrame(token_files.write(docs, where, token_files.tokenizer_path(), shard_tokens=300_000).collect())
    e = token_files.Encoder(token_files.tokenizer_path())
    ids = [x.tolist() for x in e.encode(*textbytes.column_bytes(pa.array(texts, pa.string())))]
    for word in ("rare", "the", "zebra"):
        token = e._whole([word])[0].tolist()[0]
        want = {(i, x.count(token), x.index(token)) for i, x in enumerate(ids) if token in x}
        assert {tuple(r) for r in token_files.occurrences(manifest, where, token).collect()} == want


def brute_windows(items):
    windows = {}
    for i, t in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        for a in range(len(w) - min(10, len(w)) + 1 if w and i is not None else 0):
            windows.setdefault(tuple(w[a : a + min(10, len(w))]), set()).add(i)
    return windows


@pytest.mark.parametrize("block", [10**6, 40])
def test_op9_windows(spark, sf, docs, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)  # small blocks go through the shared folder
    windows = brute_windows([(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])
    want = Counter()
    for d in docs:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(d.text))
        hit, items = set(), set()
        for n in {len(k) for k in windows}:
            for a in range(len(w) - n + 1):
                if found := windows.get(tuple(w[a : a + n])):
                    hit |= set(range(a, a + n))
                    items |= found
        want[(d.doc_id, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest(), bool(hit))] += 1
    got = Counter(tuple(r) for r in decontaminate.op9(spark, sf).collect())
    assert got == want and sum(n for k, n in want.items() if k[-1]) >= 10


def brute_shingles(text):
    """Hashes of a text's five-word shingles, as signed numbers."""
    chained = lambda hs: functools.reduce(lambda seed, h: xxhash.xxh64_intdigest(h.to_bytes(8, "little"), seed), hs, 42)
    w = [xxhash.xxh64_intdigest(x.encode(), 42) for x in re.split("[ \t\n\r\f\x0b]+", (text or "").lower()) if x]
    out = {chained(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {chained(w)} if w else set()
    return sorted(h - (1 << 64) if h >> 63 else h for h in out)


def brute_sketch(text):
    """(hashes that are kept, bound up to which they are all of them)."""
    h = brute_shingles(text)
    low = [x for x in h if x < -(1 << 63) + (1 << 61)]
    kept = low if len(low) >= 64 else h[:64]
    return kept, (1 << 63) - 1 if len(kept) == len(h) else max(-(1 << 63) + (1 << 61) - 1, kept[-1])


def brute_likeness(a, b):
    upto = min(a[1], b[1])
    x, y = ({h for h in s[0] if h <= upto} for s in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def hexed(s):
    return "".join(f"{h & (1 << 64) - 1:016X}" for h in s[0])


def test_op10_next_across_ranges(spark):
    """The next row's columns, with many small ranges, null ids, repeated ids and a range that is one row, against a plain walk."""
    rows = [(i * 7 % 101, f"t{i}", i) for i in range(101)] + [(None, "n", 200), (None, "m", 201), (50, "again", 202), (10**12, "far", 203)]
    df = spark.createDataFrame(rows, "k long, text string, n long")
    order = sorted(rows, key=lambda r: (-(-(1 << 63) if r[0] is None else r[0]), r[1]))
    want = Counter((a[2], b[1]) for a, b in zip(order, order[1:] + order[:1]))
    from pyspark.sql import functions as F

    for size in (1, 40, 10**6):
        got = sketch.with_next(df, "k", ["text"], "text", F.octet_length("text"), size).collect()
        assert Counter((r.n, r.next_text) for r in got) == want


@pytest.mark.parametrize("n", [8, 40, 64, 65, 100, 300, 511, 700, 3000])
def test_op10_error_on_both_sides_of_the_bound(spark, n):
    """Estimates against exact similarities for texts of n words: exact while all hashes are kept, else within four deviations of a sample of 64 or more."""
    import random

    from pyspark.sql import functions as F

    rng = random.Random(n)
    word = lambda: f"w{rng.randrange(10**6)}"
    a = [word() for _ in range(n)]
    cuts = [n // 4, n // 2, n * 3 // 4, n]
    others = [a[:c] + [word() for _ in range(n - c)] for c in cuts] + [a + [word() for _ in range(k * n)] for k in (1, 7)]
    df = spark.createDataFrame([(i, " ".join(a), " ".join(o)) for i, o in enumerate(others)], "i int, a string, b string")
    df = df.select("i", sketch.sketch(F.col("a")).alias("x"), sketch.sketch(F.col("b")).alias("y"))
    merged = sketch.merge(F.array("x", "y"))
    got = df.select("i", "x", "y", merged.alias("m"), sketch.likeness(F.col("x"), F.col("y")).alias("like"), sketch.likeness(merged, F.col("y")).alias("part")).collect()
    for r in got:
        sa, sb = set(brute_shingles(" ".join(a))), set(brute_shingles(" ".join(others[r.i])))
        exact = len(sa & sb) / len(sa | sb)
        seen = 64 / len(sa | sb) if len(sa | sb) > 64 else 1
        slack = 1e-9 if max(len(sa), len(sb)) <= 64 else 4 * (exact * (1 - exact) / 64 * max(0, 1 - seen)) ** 0.5 + 0.02
        assert abs(r.like - exact) <= slack, (n, r.i)
        # a merged sketch is the union's, complete up to its bound
        assert list(r.m.kept) == sorted(h for h in sa | sb if h <= r.m.upto) and r.m.upto == min(r.x.upto, r.y.upto)
        assert abs(r.part - len(sb) / len(sa | sb)) <= (1e-9 if len(sa | sb) <= 64 else 0.25)


def test_op10_next_and_edited(spark, sf, docs):
    got = sketch.op10(spark, sf).collect()
    assert len(got) == len(docs)
    key = lambda d: -(1 << 63) if d.doc_id is None else d.doc_id
    order = sorted(docs, key=lambda d: (-key(d), int(np.uint64(xxhash.xxh64_intdigest((d.text or "").encode(), 42)).view(np.int64))))
    want = Counter()
    for a, b in zip(order, order[1:] + order[:1]):
        t, u = a.text or "", b.text or ""
        h = len(t) // 2
        edited = t[: len(t) - h] + u[:h]
        own, other, following = (brute_sketch(x) for x in (t, edited, u))
        want[(a.doc_id, len(t), hashlib.sha256(edited.encode()).hexdigest(), hexed(own), hexed(other), round(brute_likeness(own, other), 9), round(brute_likeness(own, following), 9))] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == want
    text = {d.doc_id: d.text or "" for d in docs}
    same = {}
    for r in got:
        if r.doc_id is not None:
            assert same.setdefault(text[r.doc_id], r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1


def test_op10_estimates(spark):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(5)
    words = [f"w{i}" for i in range(5000)]
    a = [rng.choice(words) for _ in range(3000)]
    texts = [(0, " ".join(a)), (1, " ".join(a[:1500] + [rng.choice(words) for _ in range(1500)])), (2, " ".join(a[100:160])), (3, ""), (4, None), (5, "one two"), (6, "one two")]
    rows = spark.createDataFrame(texts, "i int, text string").select("i", sketch.sketch(F.col("text")).alias("s"))
    got = {(r.a, r.b): r for r in rows.alias("x").join(rows.alias("y")).select(F.col("x.i").alias("a"), F.col("y.i").alias("b"), sketch.likeness(F.col("x.s"), F.col("y.s")).alias("like"), sketch.containment(F.col("x.s"), F.col("y.s")).alias("inside")).collect()}
    assert got[0, 1].like == pytest.approx(1 / 3, abs=0.08) and got[2, 0].inside > 0.9 and got[0, 2].inside < 0.1
    assert got[3, 4].like == 1 and got[3, 5].like == 0 and got[5, 6].like == 1 and got[0, 0].like == 1
    merged = rows.where("i in (1, 2)").agg(F.collect_list("s").alias("s")).select(sketch.merge(F.col("s")).alias("m")).first().m
    assert set(merged.kept) <= set(rows.where("i = 1").first().s.kept) | set(rows.where("i = 2").first().s.kept)


def test_op2_some_ids_by_the_index(spark, sf):
    where = f"{sf}-warc"
    manifest = spark.createDataFrame(warc.write(spark.read.parquet(f"{sf}/pages.parquet"), f"file://{where}").collect())
    every = Counter(tuple(r) for r in warc.read(spark, manifest, f"file://{where}").collect())
    some = Counter(tuple(r) for r in warc.read(spark, manifest, f"file://{where}", [0, 7, 999]).collect())
    assert some == Counter({k: n for k, n in every.items() if k[0] in (0, 7)}) and sum(some.values()) == 3


def test_ways_beyond_the_broadcast_bounds(spark, sf, monkeypatch):
    """What is joined by a shuffle beyond a bound gives what a broadcast gives."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")

    def rows():
        return [
            sorted(map(tuple, warc.op2(spark, sf).collect()), key=repr), sorted(map(tuple, labelled.with_label(docs, labels, "toxic").collect()), key=repr),
            sorted(map(tuple, near.keep_one(spark, docs, sf, 0 if warc.BROADCAST_ROWS == 0 else 10**6).collect()), key=repr),
        ]

    want = rows()
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(labelled, "BROADCAST_ROWS", 0)
    assert rows() == want


def test_op1_features_and_votes_by_plain_loops(spark, sf):
    texts = ["", "a", "The cat, thé CAT", "12 34", "über   straße", "x" * 300]
    got = language_id.features(*textbytes.column_bytes(pa.array(texts)))
    for row, t in zip(got, texts):
        b = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in lower(t).encode())
        if sum(map(len, (x.encode() for x in texts))) < 3:
            continue
        n = Counter()
        slot = lambda x: (x * 2654435761 & 0xFFFFFFFF) >> 19
        for i in range(len(b) - 1):
            if b[i : i + 2] != b"  ":
                n[slot(b[i] << 8 | b[i + 1])] += 1
            if i + 2 < len(b) and b[i : i + 2] != b"  " and b[i + 1 : i + 3] != b"  ":
                n[slot((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) + 0x5BD1E995 & 0xFFFFFFFF)] += 1
        want = np.zeros(language_id.DIM)
        for k, v in n.items():
            want[k] = (v / sum(n.values())) ** 0.5
        assert np.allclose(row, want, atol=1e-6)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    m = language_id.train(docs)
    assert m.families == ["germanic", "romance"] and m.langs == {"germanic": ["de", "en"], "romance": ["es", "fr"]}
    sample = [r.text for r in docs.where("doc_id < 40").collect()]
    x = language_id.features(*textbytes.column_bytes(pa.array(sample)))
    lang, score = m.predict(x)
    for row, own, p in zip(x, lang, score):
        margin = [float(row @ m.weights[:, k] + m.biases[k]) for k in range(m.weights.shape[1])]
        family = m.families[int(np.argmax(margin[:2]))]
        pair = next(margin[2 + k] for k, (f, _, _) in enumerate(m.pairs) if f == family)
        assert own == m.langs[family][0 if pair > 0 else 1]
        assert p == pytest.approx(1 / (1 + np.exp(-4 * abs(margin[0] - margin[1]))) / (1 + np.exp(-4 * abs(pair))), rel=1e-3)


def test_op1_bounds_of_the_sample(spark):
    """Neither many labels nor frequent ones make the sample grow; a rare label is learned whole."""
    rows = [(i, f"text {i}", f"x{i % 50}" if i % 2 else "big") for i in range(4000)] + [(9000 + i, "rare words", "rare") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = Counter(r.lang for r in textbytes.bounded_sample(df, "doc_id", "lang", 30, 1, most_labels=60, most_rows=10**6).collect())
    assert got["rare"] == 3 and 10 <= got["big"] <= 60 and all(n <= 60 for n in got.values()) and len(got) == 27
    assert set(r.lang for r in textbytes.bounded_sample(df, "doc_id", "lang", 30, 1, most_labels=1).collect()) == {"big"}
    assert textbytes.bounded_sample(df, "doc_id", "lang", 1000, 1, most_labels=60, most_rows=270).count() < 500


def test_op5_neighbours_and_chain_change_a_score(spark, sf):
    """The same line between good lines and between bad ones is judged differently, by the transitions too."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    m = quality.train(docs, labels)
    good = "The andre of erisor tion and endesal."
    bad = "THE $$$ ### AND!! OF!! ### $$$"
    line = "Some er and in"
    def judged(model, around):
        data, offsets = textbytes.column_bytes(pa.array(["\n".join([around, around, line, around, around])]))
        x, _, first = quality.features(data, offsets)
        p = model.marginals(x, first)[2]
        return np.log(p / (1 - p))

    assert judged(m, good) > judged(m, bad) + 0.5
    without = quality.Model(m.weights, np.zeros_like(m.trans))
    assert abs(judged(m, bad) - judged(without, bad)) > 0.01 and np.abs(m.trans).max() > 1e-3


def test_texts_beyond_a_slice(spark, sf, tmp_path):
    """One text of some megabytes among short ones: languages, passages and near copies are told in it as in short texts."""
    every = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 240 and doc_id % 20 <> 3").orderBy("doc_id").collect()
    own = "\n".join(r.text for r in every if r.lang == "de")
    item = spark.read.parquet(f"{sf}/benchmark.parquet").where("item_id = 2").first().text
    long = (own + "\n") * (1 + 3 * textbytes.SLICE_BYTES // len(own)) + item
    french = next(r.text for r in every if r.lang == "fr")
    assert len(long) > 2 * textbytes.SLICE_BYTES
    docs = spark.createDataFrame([(1, long), (2, "short"), (3, long + " more words at its end"), (4, french)], "doc_id long, text string")
    model = language_id.train(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang"))
    assert {r.doc_id: r.lang_pred for r in language_id.identify(docs, model, keep=["doc_id"]).collect() if r.doc_id != 2} == {1: "de", 3: "de", 4: "fr"}
    found = {r.doc_id: (r.n_hit, r["items"]) for r in decontaminate.scan(docs, decontaminate.index(spark, spark.read.parquet(f"{sf}/benchmark.parquet")), keep=["doc_id"]).collect()}
    assert found[1][1] == ["2"] and found[1][0] >= 10 and found[2] == (0, []) and found[3][1] == ["2"]
    assert {r.doc_id: r.component_id for r in near.group(docs).collect()} == {1: 1, 2: 2, 3: 1, 4: 4}
    assert [r.doc_id for r in near.keep_one(spark, docs, "").orderBy("doc_id").collect()] == [1, 2, 4]
