"""Sparse and dense search, fusion, boosts and metrics against plain formulas and hand-made rows."""

import math
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.config import Bm25Config, SearchConfig
from tessera.functions import text as X
from tessera.operators import boost, dense, evaluate, fusion, sparse
from tessera.plans import retrieval, search


def one(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(column).collect()]


@pytest.mark.parametrize(("text", "want"), [("getSensorData", ["get", "sensor", "data"]), ("reading_value", ["reading", "value"]), ("IPMI_CMD GetSensorReading FRU", ["ipmi_cmd", "get", "sensor", "reading", "fru"]), ("a b c d ab cd", ["ab", "cd"]), ("", []), (None, [])])
def test_tokens(spark, text, want):
    assert one(spark, X.tokens(F.col("x")), text) == [want]


def test_text_functions(spark):
    assert one(spark, X.stem(F.col("x")), "a/b/read_me.tar.gz", "plain") == ["read_me.tar", "plain"]
    assert one(spark, X.name_before(F.col("x")), "lib/[1.0]", "lib[2]", " x ") == ["lib", "lib", "x"]
    assert one(spark, X.clean_query(F.col("x")), "mds", "json model", "  csr ") == ["mds", "model", "  csr "]
    assert one(spark, F.size(X.lines(F.col("x"))), "a\nb\n", "a\r\nb\rc", "") == [2, 3, 1]
    assert one(spark, X.shorten(F.col("x"), 3, "..."), "abcd", "abc") == ["abc...", "abc"]


DOCS = {1: ["cat", "dog", "cat"], 2: ["dog"], 3: ["fish", "dog", "bird", "bird"], 4: []}


def plain_bm25(docs, query, k1=1.5, b=0.75, eps=0.25):
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(t for d in docs.values() for t in set(d))
    raw = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    floor = eps * sum(raw.values()) / len(raw)
    idf = {t: floor if r < 0 else r for t, r in raw.items()}
    return {i: sum(idf[t] * d.count(t) * (k1 + 1) / (d.count(t) + k1 * (1 - b + b * len(d) / avg)) for t in query if t in idf) for i, d in docs.items()}


def frames(spark, docs, queries):
    return spark.createDataFrame(list(docs.items()), "chunk_id int, tokens array<string>"), spark.createDataFrame(list(queries.items()), "query_id int, tokens array<string>")


def test_bm25_formula(spark):
    queries = {1: ["cat"], 2: ["dog", "dog", "bird"], 3: ["none"], 4: []}
    got = {(r.query_id, r.chunk_id): r.score for r in sparse.scores(*frames(spark, DOCS, queries)).collect()}
    for q, tokens in queries.items():
        for c, want in plain_bm25(DOCS, tokens).items():
            if set(tokens) & set(DOCS[c]):
                assert got[q, c] == pytest.approx(want, abs=2e-6)
            else:
                assert (q, c) not in got
    padded = sparse.scores(*frames(spark, DOCS, queries), Bm25Config(pad_zero=True))
    assert padded.count() == 16


def test_bm25_grid_is_the_same_as_single_runs(spark):
    d, q = frames(spark, DOCS, {1: ["cat", "dog"]})
    params = spark.createDataFrame([(1.2, 0.5), (2.0, 0.0)], "k1 double, b double")
    grid = sparse.scores(d, q, params=params).collect()
    for k1, b in ((1.2, 0.5), (2.0, 0.0)):
        single = {r.chunk_id: r.score for r in sparse.scores(d, q, Bm25Config(k1=k1, b=b)).collect()}
        assert {r.chunk_id: r.score for r in grid if (r.k1, r.b) == (k1, b)} == single


@settings(max_examples=5, deadline=None)
@given(st.dictionaries(st.integers(0, 9), st.lists(st.sampled_from("abcdef"), max_size=6), min_size=2, max_size=6))
def test_bm25_any_corpus(spark, docs):
    if not any(docs.values()):
        return
    got = {r.chunk_id: r.score for r in sparse.scores(*frames(spark, docs, {0: ["a", "b", "a"]})).collect()}
    want = plain_bm25(docs, ["a", "b", "a"])
    assert got == {c: pytest.approx(want[c], abs=2e-6) for c, d in docs.items() if {"a", "b"} & set(d)}


def test_document_text(spark):
    df = spark.createDataFrame([("1", "body", "a/b.lua", "repo", [("f",), ("g",)])], "chunk_id string, content string, file_path string, repo_name string, symbols array<struct<name:string>>")
    assert df.select(sparse.document_text(df)).first()[0] == "body a/b.lua repo repo f g"


def test_nearest(spark, monkeypatch):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 0.0]), (4, [-1.0, 0.0])], "chunk_id int, embedding array<float>")
    q = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 1.0])], "query_id int, embedding array<float>")
    want = {(1, 1): 1.0, (1, 2): 0.6, (2, 2): 0.8, (2, 1): 0.0}
    assert {(r.query_id, r.chunk_id): r.score for r in dense.nearest(v, q, 2).collect()} == want
    monkeypatch.setattr(dense, "BLOCK", 1)
    assert {(r.query_id, r.chunk_id): r.score for r in dense.nearest(v, q, 2).collect()} == want
    assert dense.nearest(v, q, 2, F.col("chunk_id") == 4).count() == 2


def test_offline_vectors(spark):
    a, b, c = (r.embedding for r in dense.embed(spark.createDataFrame([("fan speed",), ("fan speed",), ("",)], "t string"), F.col("t")).collect())
    assert a == b and any(a) and not any(c)


def ranked(spark, rows, extra=""):
    return spark.createDataFrame(rows, "query_id int, chunk_id int, rank int, score double" + extra)


def test_rrf(spark):
    d, s = ranked(spark, [(1, 1, 1, 0.9), (1, 2, 2, 0.8), (1, 3, 3, 0.7)]), ranked(spark, [(1, 2, 1, 9.0), (1, 1, 2, 8.0), (1, 4, 3, 7.0)])
    got = {r.chunk_id: r for r in fusion.rrf(d, s).collect()}
    assert got[1].score == pytest.approx(0.5 / 61 + 0.5 / 62, abs=1e-9) and got[4].score == pytest.approx(0.5 / 63, abs=1e-9)
    assert [c for c, _ in sorted(got.items(), key=lambda x: x[1].rank)] == [1, 2, 3, 4]
    swapped = {r.chunk_id: r.score for r in fusion.rrf(s, d).collect()}
    assert swapped == {c: r.score for c, r in got.items()}
    code = spark.createDataFrame([(1, True)], "query_id int, is_code boolean")
    leaned = {r.chunk_id: r.score for r in fusion.rrf(d, s, SearchConfig(dense_weight=0.2), code).collect()}
    assert leaned[3] == pytest.approx(0.1 / 63, abs=1e-9) and leaned[4] == pytest.approx(0.65 / 63, abs=1e-9)
    docs = {r.chunk_id: r.score for r in fusion.rrf_docs(d, s).collect()}
    assert docs[3] == pytest.approx(1 / 63 + 1 / 64, abs=1e-9)


def test_repeated_chunks_keep_their_last_place(spark):
    assert fusion.last_position(ranked(spark, [(1, 1, 1, 0.9), (1, 1, 3, 0.1), (1, 2, 2, 0.5)])).orderBy("chunk_id").collect() == [(1, 1, 3), (1, 2, 2)]


def test_blend(spark):
    rows, ext = ranked(spark, [(1, 1, 1, 0.4), (1, 2, 2, 0.2), (2, 9, 1, 0.7)]), ranked(spark, [(1, 2, 1, 5.0), (1, 7, 2, 1.0)])
    got = {(r.query_id, r.chunk_id): r.score for r in fusion.blend(rows, ext).collect()}
    assert got == {(1, 1): 0.6, (1, 2): 0.4, (2, 9): 0.7}


def test_diversity_and_injection(spark):
    rows = ranked(spark, [(1, 1, 1, 0.9, "a"), (1, 2, 2, 0.8, "a"), (1, 3, 3, 0.5, "b")], ", file_path string")
    assert [r.chunk_id for r in fusion.diversify(rows, most=1).orderBy("rank").collect()] == [1, 3, 2]
    extra = ranked(spark, [(1, 2, 1, 1.0), (1, 8, 2, 1.0), (1, 9, 3, 1.0)])
    for at, want in ((1, [1, 8, 9, 2, 3]), (10, [1, 2, 3, 8, 9]), (0, [8, 9, 1, 2, 3])):
        assert [r.chunk_id for r in fusion.inject(rows, extra, at).orderBy("rank").collect()] == want


def test_overlap_scores(spark):
    rows = ranked(spark, [(1, 1, 1, 0.3, "sensor only"), (1, 2, 2, 0.5, "nothing"), (1, 3, 3, 0.4, "sensor reading data")], ", content string")
    q = spark.createDataFrame([(1, "sensor reading data")], "query_id int, text string")
    got = fusion.overlap_scores(rows, q).orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in got] == [(3, 0.58), (2, 0.35), (1, 0.31)]


def test_best_of_keeps_the_higher_score(spark):
    rows = spark.createDataFrame([(1, 1, 1, "p", 0.3), (1, 2, 1, "p", 0.9), (1, 1, 2, "q", 0.5), (1, 2, 3, "r", 0.7)], "group_id int, query_id int, chunk_id int, file_path string, score double")
    assert [(r.chunk_id, r.score) for r in fusion.best_of(rows, ["file_path"], 2).orderBy("rank").collect()] == [(1, 0.9), (3, 0.7)]


def test_boosts(spark):
    schema = "query_id int, chunk_id int, rank int, score double, query string, symbol_names array<string>, repo_name string, file_path string, mds_class string, chunk_type string"
    row = lambda i, q, syms, repo, path, model=None, kind="function": (1, i, i, 0.01, q, syms, repo, path, model, kind)
    rows = [
        row(1, "GetReading", ["GetReading"], "zz", "q.c"), row(2, "use GetReading now", ["x", "GetReading"], "zz", "q.c"), row(3, "the sensor_app file", [], "zz", "src/sensor_app.lua"),
        row(4, "dependency of Fan", [], "fan", "x/y.json", "Fan", "mds_service"), row(5, "powers", [], "mypowers", "a/b.c"), row(6, "src core", [], "zz", "src/core/z.lua"),
    ]
    got = {r.chunk_id: r for r in boost.boost(spark.createDataFrame(rows, schema)).collect()}
    assert (got[1].symbol_bonus, got[2].symbol_bonus) == (0.025, 0.008)
    assert (got[3].path_bonus, got[6].path_bonus) == (0.020, 0.006)
    assert (got[4].repo_bonus, got[4].model_bonus, got[4].service_bonus) == (0.006, 0.012, 0.010)
    assert got[5].repo_bonus == pytest.approx(0.0048) and got[1].score == pytest.approx(0.035)


def case(spark, expected, found):
    cases = spark.createDataFrame([(1,)], "case_id int")
    e = spark.createDataFrame([(1, "r", p, rel) for p, rel in expected], "case_id int, repo_name string, file_path string, relevance int")
    f = spark.createDataFrame([(1, i + 1, "r", p) for i, p in enumerate(found)], "case_id int, rank int, repo_name string, file_path string")
    return evaluate.case_metrics(cases, f, e).first()


@pytest.mark.parametrize(
    ("expected", "found", "want"),
    [
        ([("a", 1)], ["a", "a", "a"], {"recall_at_5": 1.0, "precision_at_3": round(1 / 3, 6), "rr": 1.0, "file_at_1": 1}),
        ([("a", 1), ("b", 1)], ["a", "x"], {"recall_at_5": 0.5, "precision_at_1": 1.0}),
        ([("a", 1), ("b", 1)], ["a", "b"], {"ap": 1.0}),
        ([("a", 1), ("b", 1)], ["x", "a", "b"], {"ap": round((1 / 2 + 2 / 3) / 2, 6), "rr": 0.5, "file_at_1": 0, "file_at_3": 1}),
        ([("a", 3)], ["a"], {"ndcg_at_5": 1.0, "ndcg_raw_at_5": 1.0}),
        ([("a", 1)], ["a", "a"], {"ndcg_at_5": 1.0, "ndcg_raw_at_5": round(1 + 1 / math.log2(3), 6)}),
        ([], ["a"], {"recall_at_5": 0.0, "precision_at_5": 0.0, "ap": 0.0, "ndcg_at_5": 0.0, "rr": None}),
        ([("a", 1)], [], {"recall_at_10": 0.0, "rr": 0.0, "file_at_10": 0}),
        ([("b/c.lua", 1), ("c.lua", 1)], ["a/b/c.lua"], {"recall_at_1": 0.5}),
    ],
)
def test_case_metrics(spark, expected, found, want):
    got = case(spark, expected, found)
    assert {k: got[k] for k in want} == want


def test_label_hits_and_bootstrap(spark):
    cases = spark.createDataFrame([(1, ["x"]), (2, []), (3, ["z"])], "case_id int, expected array<string>")
    found = spark.createDataFrame([(1, 1, ["x", "y"]), (3, 1, ["y"]), (3, 9, ["z"])], "case_id int, rank int, labels array<string>")
    assert {r.case_id: r.hit for r in evaluate.label_hits(cases, found, "expected", "labels", 5).collect()} == {1: True, 2: True, 3: False}
    m = lambda n: spark.createDataFrame([(i, float(i % 2)) for i in range(n)], "case_id int, rr double")
    assert evaluate.bootstrap(m(1), ["rr"]).count() == 0
    (ci,) = evaluate.bootstrap(m(10), ["rr"]).collect()
    assert 0 <= ci.lower <= 0.5 <= ci.upper <= 1 and ci.lower < ci.upper


def test_filters_come_before_the_cut(spark):
    """Three of 300 chunks pass the first query's filter, and all others rank before them in both lists."""
    kind = lambda i: ("python" if i >= 297 else "lua", "function" if i % 2 else "class")
    chunks = spark.createDataFrame([(i, *kind(i), f"f{i}.x") for i in range(300)], "chunk_id long, language string, chunk_type string, file_path string")
    tokens = spark.createDataFrame([(i, ["zebra"] * 3 + ["filler"] * (1 + i)) for i in range(300)] + [(1000 + i, ["other"]) for i in range(700)], "chunk_id long, tokens array<string>")
    vectors = spark.createDataFrame([(i, [1.0, i / 100]) for i in range(300)], "chunk_id long, embedding array<double>")
    queries = spark.createDataFrame([(1, "zebra python", [1.0, 0.0]), (2, "zebra", [1.0, 0.0]), (3, "zebra python method", [1.0, 0.0])], "query_id long, text string, embedding array<double>")
    e = search.Engine(chunks, tokens, vectors)
    _, *lists = e.candidates(queries, 2)
    for ranked in lists:
        got = {q: [r.chunk_id for r in ranked.orderBy("rank").collect() if r.query_id == q] for q in (1, 2, 3)}
        assert got == {1: [297, 298, 299], 2: [0, 1, 2, 3, 4, 5], 3: [297, 299]}


def test_bm25_grid_is_the_whole_grid(spark, tmp_path):
    spark.createDataFrame([(i, f"alpha{i} beta gamma{i % 3} delta", "en", "s", 30) for i in range(12)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "alpha1 beta"), (2, "alpha2 beta")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.k1, r.b): r.hits for r in retrieval.bm25_grid(spark, str(tmp_path)).collect()}
    want = {(k1, b) for k1 in (0.5, 0.8, 1.0, 1.2, 1.5, 1.8, 2.0, 2.5, 3.0) for b in (0.0, 0.15, 0.3, 0.5, 0.6, 0.75, 0.9, 1.0)}
    assert set(got) == want and set(got.values()) == {2}


def small_engine(spark, **more):
    """Six chunks in two repositories and collections, with two-dimensional vectors."""
    rows = [(i, f"text {'sensor ' * (i + 1)}number {i}", ("one", "two")[i % 2], f"dir/f{i // 2}.lua", ("lua", "c")[i // 3], "function", i * 10, ("code", "docs")[i % 2], [f"sym{i}"], None) for i in range(6)]
    chunks = spark.createDataFrame(rows, "chunk_id long, content string, repo_name string, file_path string, language string, chunk_type string, start_line int, collection string, symbol_names array<string>, mds_class string")
    tokens = sparse.tokenized(chunks, sparse.document_text(chunks))
    vectors = spark.createDataFrame([(i, [1.0, i / 3]) for i in range(6)], "chunk_id long, embedding array<double>")
    return search.Engine(chunks, tokens, vectors, **more)


def ask(spark, *texts):
    return spark.createDataFrame([(i, t, [1.0, 0.0]) for i, t in enumerate(texts)], "query_id long, text string, embedding array<double>")


def test_given_filters_override_the_words(spark):
    e = small_engine(spark)
    ids = lambda df: sorted(r.chunk_id for r in df.collect())
    assert ids(e.search(ask(spark, "sensor number in lua"), 10, "reranked")) == [0, 1, 2]
    assert ids(e.search(ask(spark, "sensor number in lua"), 10, "reranked", language="c")) == [3, 4, 5]
    assert ids(e.search(ask(spark, "sensor number"), 10, "reranked", repo="two", language="c")) == [3, 5]
    assert ids(e.search(ask(spark, "sensor number"), 10, "reranked", chunk_type="class")) == []
    own = ask(spark, "sensor number", "sensor number").withColumn("repo_name", F.when(F.col("query_id") == 0, "one"))
    got = e.search(own, 10, "hybrid").collect()
    assert sorted(r.chunk_id for r in got if r.query_id == 0) == [0, 2, 4] and len([r for r in got if r.query_id == 1]) == 6


def test_models_and_their_fallbacks(spark):
    """A cross-encoder that leaves out a query's candidate doesn't count for that query; an outer reranker's first results do."""
    def model(rows, asked):
        return rows.where("not (query_id = 1 and chunk_id = 0)").select("query_id", "chunk_id", (F.col("chunk_id") * 1.0).alias("score"))

    e = small_engine(spark, cross=model)
    got = e.search(ask(spark, "sensor number", "sensor text"), 6, "cross_encoder").collect()
    assert [r.chunk_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 0] == [5, 4, 3, 2, 1, 0]
    assert {r.query_id: r.source for r in got} == {0: "cross_encoder", 1: "cross_encoder_fallback"}
    seen = []
    def outer(rows, asked):
        seen.append(rows.agg(F.max("rank")).first()[0])
        return rows.where("query_id = 0").select("query_id", "chunk_id", (F.col("chunk_id") * 1.0).alias("score"))

    from dataclasses import replace

    config = SearchConfig(rerank_alpha=0.0, rerank_most=4, rerank_top=2)
    plain = small_engine(spark).search(ask(spark, "sensor number", "sensor text"), 6, "reranked").collect()
    got = replace(small_engine(spark), rerank=outer, config=config).search(ask(spark, "sensor number", "sensor text"), 6, "full").collect()
    assert seen == [4]
    assert [r.score for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 0][:3] == [1.0, 0.0, 0.0]
    of = lambda rows, q: [(r.chunk_id, r.score) for r in sorted(rows, key=lambda r: r["rank"]) if r.query_id == q]
    assert of(got, 1) == of(plain, 1)


def test_rewrites_that_say_nothing_new_are_not_searched(spark):
    e = small_engine(spark, config=SearchConfig(bm25_weight=0.0))
    plain = sorted(map(tuple, e.search(ask(spark, "sensor"), 1, "hybrid").collect()))
    for text, same in (("SENSOR", True), ("ab", True), ("probe", False)):
        rewrite = lambda asked, t=text: asked.select("query_id", F.lit(t).alias("text"), F.array(F.lit(0.0), F.lit(1.0)).alias("embedding"))
        got = sorted(map(tuple, small_engine(spark, rewrite=rewrite, config=SearchConfig(inject_sparse_at=0, bm25_weight=0.0)).search(ask(spark, "sensor"), 1, "hybrid").collect()))
        assert (got == plain) == same, text


def test_docs_references_and_many_queries(spark):
    e = small_engine(spark)
    docs = e.docs(ask(spark, "sensor"), 50).collect()
    assert {r.chunk_id for r in docs} == {1, 3, 5} and {r.source for r in docs} == {"docs"}
    assert e.references(ask(spark, "sensor")).count() == 6
    many = spark.createDataFrame([(i, "sensor number", [1.0, 0.0], 7) for i in range(8)], "query_id long, text string, embedding array<double>, group_id int")
    merged = e.multi(many, 10).collect()
    assert {r.query_id for r in merged} == {0} and len(merged) == 6  # of equal results the first query's count; six lines of files


def test_what_a_chunk_is_indexed_by(spark):
    schema = "chunk_id int, content string, file_path string, repo_name string, symbols array<struct<name:string>>, chunk_type string, dependencies array<string>, required_interfaces array<string>, service_name string"
    rows = [(1, "body", "src/pump.lua", "fan", [("spin",)], "mds_service", ["bus"], ["if.Speed"], "cooler"), (2, None, None, "fan", [], "file", ["bus"], [], "no")]
    got = {r.chunk_id: r.t for r in spark.createDataFrame(rows, schema).select("chunk_id", sparse.document_text(spark.createDataFrame(rows, schema)).alias("t")).collect()}
    assert got == {1: "body src/pump.lua fan fan spin bus if.Speed cooler", 2: "  fan fan "}


def test_nearest_by_plain_formula(spark):
    """Blocks of queries, filters by columns, null and odd-sized vectors, and ties, against the formula."""
    import random

    rng = random.Random(2)
    vectors = [(i, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(3)], "ab"[i % 2]) for i in range(60)] + [(60, None, "a"), (61, [], "b"), (62, [1.0], "a"), (63, [0.0] * 3, "a")]
    queries = [(i, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(3)], [None, "a", "z"][i % 3]) for i in range(9)]
    v = spark.createDataFrame(vectors, "chunk_id int, embedding array<double>, kind string")
    q = spark.createDataFrame(queries, "query_id int, embedding array<double>, filter_kind string")

    def cosine(a, b):
        a = a if a and len(a) == 3 else [0.0] * 3
        return round(sum(x * y for x, y in zip(a, b)) / (math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b)) + 1e-9), 6) + 0.0

    want = {}
    for i, b, f in queries:
        rows = sorted((-cosine(a, b), c) for c, a, kind in vectors if f in (None, kind))
        want |= {(i, c): (n + 1, -s + 0.0) for n, (s, c) in enumerate(rows[:7])}
    for block in (16_384, 4):
        dense.BLOCK, old = block, dense.BLOCK
        got = {(r.query_id, r.chunk_id): (r["rank"], r.score + 0.0) for r in dense.nearest(v, q, 7, match=("kind",)).collect()}
        dense.BLOCK = old
        assert got == want


def test_holders_by_plain_search(spark):
    texts = ["one two three four", "xone two threex", "two", "a  b\tc", None, "", "one two three"]
    items = ["one two three", "two", "b\tc", "e two t", None, "", "two three four", "missing word here"]
    t = spark.createDataFrame(list(enumerate(texts)), "chunk_id int, content string")
    i = spark.createDataFrame(list(enumerate(items)), "query_id int, item string")
    want = {(b, a) for a, x in enumerate(texts) for b, y in enumerate(items) if x is not None and y is not None and y in x}
    assert {tuple(r) for r in retrieval.holders(t, i).collect()} == want


def test_provider_of_vectors(spark):
    """Batches, the cut, a batch that fails, a text that fails, and vectors of another length."""
    def provider(texts):
        if len(texts) > 3 or any("bad" in t for t in texts):
            raise RuntimeError("no")
        return [[float(len(t)), 1.0] if t != "odd" else [1.0] for t in texts]

    rows = [(i, t) for i, t in enumerate(["a", "bb", "bad", "x" * 50, None, "odd", "ccc"])]
    df = spark.createDataFrame(rows, "i int, t string").withColumn("embedding", F.lit("clash"))
    got = {r.i: r.embedding for r in dense.embedded(df, F.col("t"), provider, 2, batch=3, most=20).collect()}
    assert got == {0: [1.0, 1.0], 1: [2.0, 1.0], 2: [0.0, 0.0], 3: [20.0, 1.0], 4: [0.0, 1.0], 5: [0.0, 0.0], 6: [3.0, 1.0]}


def test_intent_says_what_is_code(spark):
    e = small_engine(spark)
    asked = spark.createDataFrame([(0, "x = {}", [1.0, 0.0], "semantic"), (1, "words", [1.0, 0.0], "code"), (2, "x = {}", [1.0, 0.0], "none")], "query_id long, text string, embedding array<double>, intent string")
    assert {r.query_id: r.is_code for r in e.processed(asked)[0].collect()} == {0: False, 1: True, 2: True}


@pytest.mark.parametrize("cells", [1 << 24, 3])
def test_grid_is_the_best_of_all_scores(spark, monkeypatch, cells):
    """The k best for every pair by matrix products, in one block of queries and in several, against all scores; ties go to the smaller chunk."""
    import random

    rng = random.Random(9)
    docs = {i: [rng.choice("abcdefgh") * 2 for _ in range(rng.randint(0, 9))] for i in range(60)} | {100 + i: ["aa", "bb"] for i in range(5)}
    d, q = frames(spark, docs, {1: ["aa"], 2: ["bb", "bb", "hh"], 3: ["none"], 4: [], 5: ["cc", "dd", "ee"]})
    pairs = [(0.5, 0.0), (1.5, 0.75), (3.0, 1.0)]
    monkeypatch.setattr(sparse, "CELLS", cells)
    got = sorted((r.k1, r.b, r.query_id, r["rank"], r.chunk_id, round(r.score, 5)) for r in sparse.grid(d, q, pairs, 4).collect())
    all_ = sparse.scores(d, q, params=spark.createDataFrame(pairs, "k1 double, b double"))
    want = sorted((r.k1, r.b, r.query_id, r["rank"], r.chunk_id, round(r.score, 5)) for r in sparse.ranked(all_, 4, by=("k1", "b", "query_id")).collect())
    assert got == want and len(want) == 36
