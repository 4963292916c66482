"""Parsers, files, query understanding, upkeep, graph walks, judging and streams."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.config import GraphConfig, IngestConfig
from tessera.operators import agent, components, graph, incremental, query
from tessera.plans import maintenance
from tessera.sources import files, parsers
from tessera.streaming import upsert


def names(row):
    return [s["name"] for s in row["symbols"]]


def test_lua():
    small = parsers.parse_lua("r", "a.lua", "local x = 1\nreturn x")
    assert [r["chunk_type"] for r in small] == ["file"]
    text = "local class = require 'mc.class'\nlocal App = class(base)\n" + "".join(f"function App:m{i}(a)\n  if a then return 'end' end -- end\n  return function() return a end\nend\n\n" for i in range(5)) + "local function help(x)\n  return x\nend\n"
    rows = parsers.parse_lua("r", "a.lua", text)
    assert [r["chunk_type"] for r in rows] == ["class", *["method"] * 5, "function"]
    assert names(rows[1]) == ["App:m0"] and rows[1]["content"].startswith("function App:m0") and rows[1]["content"].endswith("end")
    assert all(r["start_line"] <= r["end_line"] for r in rows)
    plain = "\n".join(f"x{i} = {i}" for i in range(400))
    assert [(r["chunk_type"], r["start_line"], r["end_line"]) for r in parsers.parse_lua("r", "a.lua", plain)] == [("block", 1, 150), ("block", 146, 295), ("block", 291, 400)]


def test_c():
    text = '#include "a.h"\n\ntypedef struct box {\n    int n;\n} box_t;\n\nstruct bag { int m; };\n\nstatic int grab(box_t *b, int k) {\n    if (k) { return 1; }\n    char c = \'}\';\n    return 0;\n}\n'
    rows = parsers.parse_c("r", "x.c", text)
    assert [(r["chunk_type"], names(r)) for r in rows] == [("typedef", ["box"]), ("class", ["bag"]), ("function", ["grab"])] and rows[0]["language"] == "c"
    assert parsers.parse_c("r", "x.cc", "int a;")[0]["chunk_type"] == "file" and parsers.parse_c("r", "x.cc", "int a;")[0]["language"] == "cpp"


def test_python():
    body = "\n".join(f"    def m{i}(self):\n        return {i}\n" for i in range(30))
    rows = parsers.parse_python("r", "a.py", f"class A:\n{body}\n\ndef top():\n    pass\n")
    assert [(r["chunk_type"], r["start_line"]) for r in rows] == [("class", 1), ("function", 93)]
    assert parsers.parse_python("r", "a.py", "def f():\n    pass\n")[0]["chunk_type"] == "file"


def test_markdown():
    text = "---\ntitle: 'T'\n---\n# A\nx\n## B\n```\n# code\n```\n##### deep\n# C\ny"
    rows = parsers.parse_markdown("r", "d/a.md", text)
    assert [(names(r)[0], r["start_line"], r["end_line"]) for r in rows] == [("A", 4, 10), ("B", 6, 10), ("C", 11, 12)] and rows[0]["metadata"] == {"doc_title": "T"}
    assert names(parsers.parse_markdown("r", "d/a.md", "no heading")[0]) == ["a"]
    assert len(parsers.parse_markdown("r", "a.md", text, fences=False)) == 4
    long = "# L\n" + "\n".join("para" if i % 3 else "" for i in range(450))
    parts = parsers.parse_markdown("r", "a.md", long)
    assert names(parts[0])[0].startswith("L (1/") and sum(r["end_line"] - r["start_line"] + 1 for r in parts) == 451


@pytest.mark.parametrize(("deps", "want"), [(["a/1.0", {"name": "b"}], ["a/1.0", "b"]), ({"build": ["a/1.0", {"conan": "b/2"}], "x": "no"}, ["a", "b"]), ("bad", [])])
def test_service(deps, want):
    (row,) = parsers.parse_json("r", "mds/service.json", json.dumps({"name": "s", "dependencies": deps, "required": ["i", {"interface": "j"}, 3]}))
    assert row["dependencies"] == want and row["required_interfaces"] == ["i", "j"] and row["chunk_type"] == "mds_service"


def test_json_kinds():
    kinds = lambda p, d: [(r["chunk_type"], names(r)) for r in parsers.parse_json("r", p, json.dumps(d))]
    assert kinds("model.json", {"models": {"A": {"properties": {"x": 1}}, "n": 3}}) == [("mds_model", ["A", "x"])]
    assert kinds("ipmi.json", {"Get": {"netfn": "0x1"}}) == [("mds_ipmi_cmd", ["Get"])]
    assert kinds("types.json", {"defs": {"E": {"type": "enum"}, "S": {}}}) == [("mds_type_def", ["E"]), ("mds_type_def", ["S"])]
    assert kinds("b.sr", {"ManagementTopology": {}, "Objects": {"Fan_1": {}}}) == [("csr_topology", ["ManagementTopology"]), ("csr_object", ["Fan_1"])]
    assert kinds("other.json", {"a": 1}) == [("config_block", [])]
    assert parsers.parse_json("r", "model.json", "not valid json {")[0]["chunk_type"] == "config_block"
    assert parsers.key_range(['{', ' "A": {', '  "x": 1', ' },', '}'], "A") == (2, 4)


def test_windows_and_parse(spark):
    text = "\n".join(f"l{i}" for i in range(300)) + "\n" + "\n" * 200
    rows = parsers.line_windows(spark.createDataFrame([(text,)], "content string"), IngestConfig()).orderBy("start_line").collect()
    assert [(r.start_line, r.end_line) for r in rows] == [(1, 150), (146, 295), (291, 440)]
    chunks = maintenance.parsed(spark).collect()
    assert len({c.chunk_id for c in chunks}) == len(chunks) and {c.chunk_type for c in chunks} >= {"method", "typedef", "mds_service", "mds_model", "doc_section", "config_block"}
    again = {c.chunk_id for c in maintenance.parsed(spark).collect()}
    assert again == {c.chunk_id for c in chunks}  # names depend on contents only


def test_ignore_rules(spark):
    df = spark.createDataFrame([(p,) for p in ("a/x.log", "x.log/y", "build/z", "src/build/z", "keep.log", "docs/a/b.tmp")], "p string")
    got = {r.p: r.i for r in df.select("p", files.ignored(F.col("p"), ["*.log", "!keep.log", "/build/", "docs/**/*.tmp"]).alias("i")).collect()}
    assert got == {"a/x.log": True, "x.log/y": True, "build/z": True, "src/build/z": False, "keep.log": False, "docs/a/b.tmp": True}


def test_scan_save_load(spark, tmp_path):
    for p, t in (("one/src/a.lua", "return 1"), ("one/b.json", "{}"), ("two/c.md", "  \n"), ("two/d.md", "# x")):
        (tmp_path / "tree" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / p).write_text(t)
    rows = files.scan(spark, f"{tmp_path}/tree")
    assert sorted((r.repo_name, r.file_path) for r in rows.collect()) == [("one", "b.json"), ("one", "src/a.lua"), ("two", "d.md")]
    assert files.scan(spark, f"{tmp_path}/tree", ["two"]).count() == 1
    where = f"{tmp_path}/index"
    assert files.load(spark, where, "chunks") is None
    files.save(rows, where, "chunks")
    files.save(rows.limit(1), where, "chunks")
    assert files.load(spark, where, "chunks").count() == 1
    (tmp_path / "cases.json").write_text(json.dumps({"test_cases": [{"id": "1", "query": "q", "expected_files": [{"repo_name": "r", "file_path": "p"}]}]}))
    case = files.load_cases(spark, f"{tmp_path}/cases.json").first()
    assert files.load_cases(spark, f"{tmp_path}/cases.json", most=5).count() == 1
    assert case.query_type == "semantic_match" and case.difficulty == "normal" and case.expected_files[0].relevance == 1
    with pytest.raises(FileNotFoundError):
        files.load_cases(spark, f"{tmp_path}/none.json")
    files.save_report(rows.select("repo_name"), f"{tmp_path}/report")
    assert sorted(json.loads(r.value)["repo_name"] for r in spark.read.text(f"{tmp_path}/report").collect()) == ["one", "one", "two"]


def test_scan_of_unusual_names_and_bytes(spark, tmp_path):
    """Bytes that are no UTF-8, names with signs that patterns know, and a folder that repeats its repository's name."""
    for p, t in (("c++/src/a.lua", b"x \xff y"), ("src/src/a.lua", b"two"), ("a b%20/k[1].md", "# \u00e4".encode()), ("x.lua", b"no repository")):
        (tmp_path / "tree" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / p).write_bytes(t)
    for root in (f"{tmp_path}/tree", f"file://{tmp_path}/tree/"):
        got = {(r.repo_name, r.file_path): r.content for r in files.scan(spark, root).collect()}
        assert got == {("c++", "src/a.lua"): "x \ufffd y", ("src", "src/a.lua"): "two", ("a b%20", "k[1].md"): "# \u00e4"}
    rows = spark.createDataFrame([("src", "src/a.lua"), ("c++", "data/repos/c++/a.lua"), ("src", "data/repos/c++/a.lua"), ("src", "data/repos/src/src/a.lua")], "r string, p string")
    assert [r[0] for r in rows.select(files.normal_path(F.col("p"), F.col("r"))).collect()] == ["src/a.lua", "a.lua", "data/repos/c++/a.lua", "src/a.lua"]


def test_ingest_with_each_repository_s_own_rules(spark, tmp_path):
    body = "local function read(a)\n    return a + 1 -- more than thirty characters\nend\n"
    tree = {"one/.gitignore": "# gone\n*.gen.lua\n/out/\n!keep.gen.lua\n", "one/a.lua": body, "one/b.gen.lua": body, "one/keep.gen.lua": body, "one/out/c.lua": body, "one/sub/out/d.lua": body, "two/b.gen.lua": body, "two/.git/HEAD": "x", "docs/guide.md": "# Guide\nmore than thirty characters of text", "two/tests/t.lua": body, "two/s.lua": "short"}
    for p, t in tree.items():
        (tmp_path / "tree" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / p).write_text(t)
    got = files.ingest(spark, f"{tmp_path}/tree").select("repo_name", "file_path", "collection").collect()
    assert sorted(map(tuple, got)) == [("docs", "guide.md", "docs"), ("one", "a.lua", "code"), ("one", "keep.gen.lua", "code"), ("one", "sub/out/d.lua", "code"), ("two", "b.gen.lua", "code")]
    assert {r.repo_name for r in files.ingest(spark, f"{tmp_path}/tree", repos=["two", "none"]).collect()} == {"two"}
    assert files.repositories(spark, f"{tmp_path}/tree") == ["two"] and files.repositories(spark, f"{tmp_path}/none") == []


def test_scratch_tables(spark):
    from pathlib import Path

    from tessera.sources import scratch

    df = scratch.stored(spark.range(3), "three")
    where = Path(df.inputFiles()[0].removeprefix("file://")).parent
    assert df.count() == 3 and where.exists()
    assert scratch.clear(spark) >= 1 and not where.exists() and scratch.clear(spark) == 0


def test_settings_of_a_file(tmp_path):
    from tessera.config import EngineConfig

    assert EngineConfig.read(f"{tmp_path}/none.json") == EngineConfig()
    (tmp_path / "c.json").write_text(json.dumps({"search": {"rrf_k": 10}, "ingest": {"exclude": ["x/"]}}))
    got = EngineConfig.read(f"{tmp_path}/c.json")
    assert got.search.rrf_k == 10 and got.search.max_top_k == 50 and got.ingest.exclude == ("x/",) and got.bm25 == EngineConfig().bm25
    (tmp_path / "c.json").write_text('{"nothing": {}}')
    with pytest.raises(ValueError, match="nothing"):
        EngineConfig.read(f"{tmp_path}/c.json")


def test_checksums_are_of_the_joined_contents(spark):
    import hashlib

    rows = spark.createDataFrame([(2, "r", "a", "two"), (1, "r", "a", "one"), (3, "r", "b", None)], "chunk_id int, repo_name string, file_path string, content string")
    assert {r.file_key: r.md5 for r in incremental.file_checksums(rows).collect()} == {"r:a": hashlib.md5(b"one\ntwo").hexdigest(), "r:b": hashlib.md5(b"").hexdigest()}


def test_spelling_and_processing(spark):
    assert query.closest("sensr", ["sensor", "bus"]) == "sensor" and query.closest("sensor", ["sensor"]) is None and query.closest("xy", ["xyz"]) is None
    q = spark.createDataFrame([(1, "sensr 阈值 json cmd"), (2, "plain words")], "query_id int, text string")
    got = {r.query_id: r for r in query.process(q).collect()}
    assert {"sensor", "threshold", "command"} <= set(got[1].expansion) and got[1].expanded.startswith("sensr 阈值 json cmd ")
    assert got[1].filter_language == "json" and got[1].cleaned == "sen 阈值  cmd" and got[1].has_cjk and not got[2].has_cjk
    assert got[2].keywords == ["plain", "words"] and got[2].filter_language is None


def test_upkeep(spark):
    s = "chunk_id int, repo_name string, file_path string, content string"
    old = spark.createDataFrame([(1, "r", "same", "a"), (2, "r", "changed", "b"), (3, "r", "changed", "c"), (4, "r", "gone", "d")], s)
    new = spark.createDataFrame([(1, "r", "same", "a"), (5, "r", "changed", "B"), (6, "r", "added", "e")], s)
    diff = incremental.checksum_diff(incremental.file_checksums(old), incremental.file_checksums(new))
    assert {r.file_key: r.state for r in diff.collect()} == {"r:same": "unchanged", "r:changed": "changed", "r:gone": "deleted", "r:added": "added"}
    assert {r.chunk_id for r in incremental.upsert(old, new, diff).collect()} == {1, 5, 6}
    fresh = new.withColumn("content", F.when(F.col("chunk_id") != 5, F.col("content")))
    assert {r.chunk_id for r in incremental.merge_rows(old, fresh, required="content").collect()} == {1, 2, 3, 4, 6}


def test_graph(spark):
    nodes = spark.createDataFrame([(n,) for n in "abcd"], "node_id string")
    edges = spark.createDataFrame([("a", "b", "CALLS", 1), ("a", "b", "IMPORTS", 2), ("b", "c", "CALLS", 3), ("c", "x", "CALLS", 4), ("c", "d", "BELONGS_TO", 5)], "src string, dst string, edge_type string, o int")
    ok = graph.sound(edges, nodes)
    assert ok.count() == 4
    assert {(r.src, r.dst): r.edge_type for r in graph.sound(edges, nodes, True, "o").collect()} == {("a", "b"): "IMPORTS", ("b", "c"): "CALLS", ("c", "d"): "BELONGS_TO"}
    seed = spark.createDataFrame([("a",)], "node_id string")
    assert {r.node_id: r.score for r in graph.bfs(ok, seed, 2).collect()} == {"a": 1.0, "b": 0.5, "c": round(1 / 3, 6)}
    assert [r.neighbor for r in graph.neighbors(ok, seed, "out").collect()] == ["b"] and graph.neighbors(ok, seed, "in").count() == 0
    start = spark.createDataFrame([(1, "a", 0.15)], "query_id int, node_id string, score double")
    assert {r.node_id: r.score for r in graph.decay_expand(ok, start, GraphConfig()).collect()} == {"a": 0.15, "b": 0.075}
    need = spark.createDataFrame([("a", "i", "REQUIRES_IFACE"), ("b", "i", "REQUIRES_IFACE")], "src string, dst string, edge_type string")
    assert {r.node_id: r.score for r in graph.peers(need, start).collect()} == {"a": 0.15, "b": 0.3}


def test_graph_seeds_and_results(spark):
    nodes = spark.createDataFrame([("fan", "component", "fan", None), ("fan:a.lua:spin", "entity", "spin", "c1"), ("fan:a.lua:stop", "entity", "stop", "c2")], "node_id string, node_type string, name string, chunk_id string")
    results = spark.createDataFrame([(1, "c1", 2, "fan", "a.lua", ["spin"])], "query_id int, chunk_id string, rank int, repo_name string, file_path string, symbol_names array<string>")
    queries = spark.createDataFrame([(1, "how does fan stop")], "query_id int, text string")
    seeds = graph.seeds(results, queries, nodes)
    assert {r.node_id: r.score for r in seeds.collect()} == {"fan": 0.9, "fan:a.lua:spin": 0.25, "fan:a.lua:stop": 0.3}
    assert [(r.chunk_id, r.rank) for r in graph.to_results(seeds, nodes, results).collect()] == [("c2", 1)]


def test_judging_and_history(spark):
    raw = ['```json\n{"accuracy": 8, "completeness": 8, "evidence": 8, "clarity": 8}\n```', 'so {"accuracy": 10} it is', "none", None]
    rows = agent.judged(spark.createDataFrame(list(enumerate(raw)), "i int, raw string")).orderBy("i").collect()
    assert [(r.weighted, r.passed) for r in rows] == [(8.0, True), (3.0, False), (0.0, False), (0.0, False)]
    talk = spark.createDataFrame([(1, i, "tool" if i % 2 else "assistant", "x" * 2500) for i in range(50)], "conv_id int, turn int, role string, text string")
    kept = agent.trim_history(talk).collect()
    assert len(kept) == 40 and min(r.turn for r in kept) == 10 and {len(r.text) for r in kept if r.role == "tool"} == {2015}
    assert agent.last_answer(talk).first().turn == 48


def test_lookup_prefers_the_first_collection(spark):
    a, b = (spark.createDataFrame(rows, "chunk_id int, v string") for rows in ([(1, "code")], [(1, "docs"), (2, "docs")]))
    assert {r.chunk_id: r.v for r in components.lookup([a, b], spark.createDataFrame([(1,), (2,), (3,)], "chunk_id int")).collect()} == {1: "code", 2: "docs"}


def test_stream(spark, tmp_path):
    """Batches rewrite the buckets they touch, a batch that is tried again changes nothing, and old versions go."""
    schema, src, out = "chunk_id int, content string", f"{tmp_path}/in", f"{tmp_path}/out"
    run = lambda ck="ck": upsert.upsert_stream(spark, src, schema, out, f"{tmp_path}/{ck}", buckets=4)
    add = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    now = lambda: sorted(map(tuple, upsert.latest(spark, out).select("chunk_id", "content").collect()))
    assert upsert.latest(spark, out) is None
    add([(1, "a"), (2, "b")])
    run()
    add([(2, "B"), (3, "c")])
    run()
    assert now() == [(1, "a"), (2, "B"), (3, "c")]
    assert sorted(map(tuple, upsert.latest(spark, out, before=1).collect())) == [(1, "a"), (2, "b")]
    for i in range(4):
        add([(i, f"{i}")])
        run()
    want = [(0, "0"), (1, "1"), (2, "2"), (3, "3")]
    assert now() == want
    versions = {*upsert.commit(spark, out).values(), *upsert.commit(spark, out, before=5).values()}
    assert set(upsert._listed(spark, f"{out}/data")) == versions
    run()
    assert now() == want


def test_stored_index(spark, tmp_path):
    from tessera.operators import sparse
    from tessera.plans import index

    s = "chunk_id int, content string, file_path string, repo_name string"
    old = spark.createDataFrame([(1, "cat dog cat", "a", "r"), (2, "dog", "b", "r"), (3, "fish dog bird bird", "c", "r"), (4, "", "d", "r")], s)
    queries = spark.createDataFrame([(1, ["cat"]), (2, ["dog", "dog", "bird"])], "query_id int, tokens array<string>")
    assert index.load_index(spark, f"{tmp_path}/i") is None
    index.build_index(old, f"{tmp_path}/i")
    direct = sparse.ranked(sparse.scores(sparse.tokenized(old, sparse.document_text(old)), queries), 3, source="bm25")
    key = lambda df: sorted((r.query_id, r.chunk_id, r.rank, r.score) for r in df.collect())
    assert key(index.search_index(spark, f"{tmp_path}/i", queries, 3)) == key(direct)
    new = spark.createDataFrame([(1, "cat dog cat", "a", "r"), (5, "cat cat bird", "b", "r")], s)
    diff = index.update_index(spark, f"{tmp_path}/i", new, f"{tmp_path}/j")
    assert {r.file_key: r.state for r in diff.collect()} == {"r:a": "unchanged", "r:b": "changed", "r:c": "deleted", "r:d": "deleted"}
    assert {r.chunk_id for r in index.search_index(spark, f"{tmp_path}/j", queries, 3).where("query_id = 1").collect()} == {1, 5}
    index.build_index(new, f"{tmp_path}/k")
    for name in ("chunks", "postings", "doc_stats", "term_stats", "corpus_stats", "checksums"):
        tables = [spark.read.parquet(f"{tmp_path}/{x}/{name}") for x in "jk"]
        assert sorted(map(tuple, tables[0].collect())) == sorted(map(tuple, tables[1].select(*tables[0].columns).collect())), name
