"""Graph queries: over the order tables as a typed graph, and over the sample files' own graph."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.config import GraphConfig
from tessera.operators import graph as G
from tessera.plans import corpus as C
from tessera.plans.maintenance import parsed
from tessera.plans.registry import query
from tessera.sources import files, parsers
from tessera.sources.scratch import stored
from tessera.streaming.upsert import windowed

# A nation is a component, its customers and suppliers are files, parts are entities; orders and line items are edges.
SQL_NODES = """nodes AS (SELECT 'n' || n_nationkey AS node_id, 'component' AS node_type, n_name AS name FROM nation UNION ALL SELECT 'c' || c_custkey, 'file', c_name FROM customer
UNION ALL SELECT 's' || s_suppkey, 'file', s_name FROM supplier UNION ALL SELECT 'p' || p_partkey, 'entity', p_name FROM part)"""
SQL_EDGES = """raw AS (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst, 'BELONGS_TO' AS edge_type, 1.0::DOUBLE AS weight FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'BELONGS_TO', 1.0::DOUBLE FROM supplier
UNION ALL SELECT 's' || l_suppkey, 'p' || l_partkey, 'CALLS', count(*)::DOUBLE FROM lineitem GROUP BY ALL),
edges AS (SELECT raw.* FROM raw SEMI JOIN nodes a ON raw.src = a.node_id SEMI JOIN nodes b ON raw.dst = b.node_id)"""
SQL_GRAPH = f"{SQL_NODES}, {SQL_EDGES}"
SQL_BOTH = "both_ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges)"


def tables(spark, sf):
    t = lambda n: C.table(spark, sf, n)
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    node = lambda df, i, kind, name: df.select(i.alias("node_id"), F.lit(kind).alias("node_type"), F.col(name).alias("name"))
    nodes = node(t("nation"), key("n", "n_nationkey"), "component", "n_name").unionByName(node(t("customer"), key("c", "c_custkey"), "file", "c_name"))
    nodes = nodes.unionByName(node(t("supplier"), key("s", "s_suppkey"), "file", "s_name")).unionByName(node(t("part"), key("p", "p_partkey"), "entity", "p_name"))
    edge = lambda df, a, b, kind, w: df.select(a.alias("src"), b.alias("dst"), F.lit(kind).alias("edge_type"), w.alias("weight"))
    one = F.lit(1.0)
    edges = edge(t("customer"), key("c", "c_custkey"), key("n", "c_nationkey"), "BELONGS_TO", one).unionByName(edge(t("supplier"), key("s", "s_suppkey"), key("n", "s_nationkey"), "BELONGS_TO", one))
    bought = t("lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).cast("double").alias("w"))
    edges = edges.unionByName(edge(bought, key("s", "l_suppkey"), key("p", "l_partkey"), "CALLS", F.col("w")))
    return nodes, G.sound(edges, nodes)


@query("graph_nodes", f"WITH {SQL_NODES} SELECT * FROM nodes")
def graph_nodes(spark, sf):
    return tables(spark, sf)[0]


@query("graph_edges", f"WITH {SQL_GRAPH} SELECT * FROM edges")
def graph_edges(spark, sf):
    return tables(spark, sf)[1]


@query("graph_type_counts", f"WITH {SQL_GRAPH} SELECT node_type AS type, count(*) AS n, 'node' AS kind FROM nodes GROUP BY 1 UNION ALL SELECT edge_type, count(*), 'edge' FROM edges GROUP BY 1")
def graph_type_counts(spark, sf):
    return G.type_counts(*tables(spark, sf))


@query("graph_neighbors", f"WITH {SQL_GRAPH} SELECT DISTINCT node_id, neighbor FROM (SELECT src AS node_id, dst AS neighbor FROM edges UNION ALL SELECT dst, src FROM edges) WHERE node_id IN (SELECT node_id FROM nodes WHERE node_type = 'component')")
def graph_neighbors(spark, sf):
    nodes, edges = tables(spark, sf)
    return G.neighbors(edges, nodes.where("node_type = 'component'"))


@query("graph_bfs", f"""WITH {SQL_GRAPH}, {SQL_BOTH}, s AS (SELECT node_id AS seed, node_id, 0 AS h FROM nodes WHERE node_type = 'component'),
a AS (SELECT seed, dst AS node_id, 1 AS h FROM s JOIN both_ways ON src = node_id), b AS (SELECT DISTINCT seed, dst AS node_id, 2 AS h FROM a JOIN both_ways ON src = node_id)
SELECT seed, node_id, round(1 / (min(h) + 1)::DOUBLE, 6) AS score FROM (SELECT * FROM s UNION ALL SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL""")
def graph_bfs(spark, sf):
    nodes, edges = tables(spark, sf)
    return G.bfs(edges, nodes.where("node_type = 'component'").select("node_id"))


_SEEDS = "seeds AS (SELECT n_nationkey AS query_id, 's' || s_suppkey AS node_id, 0.8::DOUBLE / row_number() OVER (PARTITION BY n_nationkey ORDER BY s_suppkey) AS score FROM supplier JOIN nation ON n_nationkey = s_nationkey)"


def seeded(spark, sf):
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))
    return C.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("query_id"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node_id"), (F.lit(0.8) / nth).alias("score"))


@query("graph_decay_expand", f"""WITH {SQL_GRAPH}, {_SEEDS}, w AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM edges WHERE edge_type = 'CALLS' UNION ALL SELECT dst, src FROM edges WHERE edge_type = 'CALLS')),
a AS (SELECT query_id, node_id, max(score) AS score FROM (SELECT * FROM seeds UNION ALL SELECT query_id, dst, score * 0.5 FROM seeds JOIN w ON src = node_id WHERE score * 0.5 >= 0.05) GROUP BY ALL),
b AS (SELECT query_id, node_id, max(score) AS score FROM (SELECT * FROM a UNION ALL SELECT query_id, dst, score * 0.5 FROM a JOIN w ON src = node_id WHERE score * 0.5 >= 0.05) GROUP BY ALL)
SELECT query_id, node_id, round(score, 6) AS score FROM b""")
def graph_decay_expand(spark, sf):
    _, edges = tables(spark, sf)
    return G.decay_expand(edges, seeded(spark, sf), GraphConfig(), ("CALLS",))


@query("graph_peers", f"""WITH {SQL_GRAPH}, {_SEEDS}, need AS (SELECT src, dst FROM edges WHERE edge_type = 'CALLS'), o AS (SELECT DISTINCT query_id, b.src AS node_id FROM seeds JOIN need a ON a.src = node_id JOIN need b ON b.dst = a.dst)
SELECT query_id, node_id, round(score, 6) AS score FROM seeds UNION ALL SELECT query_id, node_id, 0.3::DOUBLE FROM o ANTI JOIN seeds USING (query_id, node_id)""")
def graph_peers(spark, sf):
    """Suppliers that sell a part which a seed sells too."""
    _, edges = tables(spark, sf)
    need = edges.where("edge_type = 'CALLS'").withColumn("edge_type", F.lit("REQUIRES_IFACE"))
    return G.peers(need, seeded(spark, sf)).withColumn("score", F.round("score", 6))


def own_graph(spark):
    """The graph of the sample files' chunks."""
    chunks = stored(parsed(spark), "sample-chunks")  # walks read them many times
    nodes = G.nodes(chunks)
    modules = chunks.select(F.col("file_path").alias("module"), F.col("repo_name").alias("component")).distinct()
    edges = G.structure(chunks).unionByName(G.imports(chunks, modules)).unionByName(G.calls(chunks))
    return chunks, nodes, G.sound(edges, nodes)


@query("graph_from_files")
def graph_from_files(spark, sf):
    return own_graph(spark)[2]


#: A nation is a component, a supplier one of its files (every fifth the main one), a part that it sells an entity, which calls the same part of the next supplier.
_SOLD = """ent AS (SELECT DISTINCT 'n' || s_nationkey AS comp, 'n' || s_nationkey || ':s' || s_suppkey || CASE WHEN s_suppkey % 5 = 0 THEN '_app.lua' ELSE '.lua' END AS file, s_suppkey AS s, l_partkey AS p FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
e AS (SELECT *, file || ':p' || p AS node_id, lead(file || ':p' || p) OVER (PARTITION BY p ORDER BY s) AS callee FROM ent),
seen AS (SELECT substr(comp, 2)::BIGINT AS query_id, node_id, 1.0::DOUBLE / n AS score FROM (SELECT *, row_number() OVER (PARTITION BY comp ORDER BY s, p) AS n FROM e) WHERE n <= 2)"""


def sold(spark, sf):
    """(comp, file, s, p, node_id, callee) of what suppliers sell."""
    t = C.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")).distinct()
    named = F.concat(F.lit("n"), F.col("s_nationkey").cast("string"))
    file = F.concat(named, F.lit(":s"), F.col("s").cast("string"), F.when(F.col("s") % 5 == 0, "_app.lua").otherwise(".lua"))
    rows = t.join(C.table(spark, sf, "supplier"), F.col("s") == F.col("s_suppkey")).select(named.alias("comp"), file.alias("file"), "s", "p", F.concat(file, F.lit(":p"), F.col("p").cast("string")).alias("node_id"))
    return stored(rows.withColumn("callee", F.lead("node_id").over(Window.partitionBy("p").orderBy("s"))), "sold")


@query("graph_cross_calls", f"""WITH {_SOLD}, own AS (SELECT seen.*, file FROM seen JOIN e USING (node_id)),
sib AS (SELECT query_id, e.node_id, own.score * 0.3::DOUBLE AS score FROM own JOIN e USING (file)),
src AS (SELECT query_id, node_id, max(score) AS score FROM (SELECT query_id, node_id, score FROM own UNION ALL (SELECT * FROM sib ANTI JOIN seen USING (query_id, node_id))) GROUP BY ALL),
hit AS (SELECT query_id, t.node_id, t.comp, t.file, max(src.score) * 0.6::DOUBLE AS score FROM src JOIN e f ON f.node_id = src.node_id JOIN e t ON t.node_id = f.callee WHERE t.comp <> f.comp GROUP BY ALL),
fresh AS (SELECT * FROM hit ANTI JOIN seen USING (query_id, node_id)),
near AS (SELECT query_id, e.node_id, fresh.score * 0.4::DOUBLE AS score FROM fresh JOIN e USING (file)),
main AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY node_id) AS n FROM e WHERE file LIKE '%\\_app.lua' ESCAPE '\\') WHERE n <= 5),
app AS (SELECT query_id, main.node_id, best.score * 0.3::DOUBLE AS score FROM (SELECT query_id, comp, max(score) AS score FROM fresh GROUP BY ALL) best JOIN main USING (comp)),
known AS (SELECT query_id, node_id FROM seen UNION SELECT query_id, node_id FROM fresh),
more AS (SELECT query_id, node_id, max(score) AS score FROM (SELECT * FROM near UNION ALL SELECT * FROM app) ANTI JOIN known USING (query_id, node_id) GROUP BY ALL)
SELECT query_id, node_id, round(score, 6) AS score FROM (SELECT query_id, node_id, score FROM fresh UNION ALL SELECT * FROM more)""")
def graph_cross_calls(spark, sf):
    """What a nation's first two entities, and the others of their file, lead to in other nations."""
    e = sold(spark, sf)
    nodes = e.select("node_id", F.lit("entity").alias("node_type"), F.col("node_id").alias("name"), F.col("node_id").alias("chunk_id"))
    edge = lambda a, b, t: e.where(F.col(b).isNotNull()).select(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(t).alias("edge_type"))
    n = F.row_number().over(Window.partitionBy("comp").orderBy("s", "p"))
    seen = e.withColumn("n", n).where("n <= 2").select(F.expr("cast(substring(comp, 2) as bigint)").alias("query_id"), "node_id", (F.lit(1.0) / F.col("n")).alias("score"))
    return G.cross_calls(edge("file", "node_id", "CONTAINS").unionByName(edge("node_id", "callee", "CALLS")), nodes, seen)


# ---------------------------------------------------------------- code made from the documents' ids
#: Functions of each file.
EACH = 7


def code_files(spark, sf):
    """A file for each document: Lua, C or a service description, by its id. Function i calls function i + 1, the last the first of the file."""
    id_ = F.col("doc_id").cast("string")
    docs = C.table(spark, sf, "documents").select("doc_id", F.col("source").alias("repo_name"))
    parts = lambda x: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(EACH - 1)), x), "\n")
    nth = lambda p, k: F.concat(F.lit(p), id_, F.lit("_"), k.cast("string"))
    lua = parts(lambda k: F.concat(F.lit("local function "), nth("f_", k), F.lit("(a)\n    return "), nth("f_", F.pmod(k + 1, F.lit(EACH))), F.lit("(a)\nend\n")))
    c = parts(lambda k: F.concat(F.lit("int "), nth("g_", k), F.lit("(int a) {\n    return "), nth("g_", F.pmod(k + 1, F.lit(EACH))), F.lit("(a);\n}\n")))
    service = F.concat(F.lit('{"name": "s'), id_, F.lit('", "version": "1.0", "dependencies": [{"name": "dep'), (F.col("doc_id") % 5).cast("string"), F.lit('/[>=1.0]"}, "src1"], "required": [{"interface": "if.'), (F.col("doc_id") % 9).cast("string"), F.lit('"}]}'))
    kind = F.col("doc_id") % 3
    return docs.select(
        "doc_id", "repo_name", F.when(kind == 0, F.concat(F.lit("lua/"), id_, F.lit(".lua"))).when(kind == 1, F.concat(F.lit("c/"), id_, F.lit(".c"))).otherwise(F.concat(F.lit("mds/"), id_, F.lit("/service.json"))).alias("file_path"),
        F.when(kind == 0, lua).when(kind == 1, c).otherwise(service).alias("content"),
    )


def code_chunks(spark, sf):
    """The files' chunks, kept as a table: the graph reads them many times."""
    return stored(files.long_enough(parsers.parse(files.wanted(code_files(spark, sf)))), "code-chunks")


_CODE_FILES = f"""d AS (SELECT doc_id, source AS repo_name, CASE doc_id % 3 WHEN 0 THEN 'lua/' || doc_id || '.lua' WHEN 1 THEN 'c/' || doc_id || '.c' ELSE 'mds/' || doc_id || '/service.json' END AS file_path, doc_id % 3 AS kind, CASE doc_id % 3 WHEN 0 THEN 'f_' ELSE 'g_' END || doc_id || '_' AS p FROM documents),
fn AS (SELECT repo_name, file_path, kind, i, p || i AS name, p || (i + 1) % {EACH} AS callee, 4 * i + 1 AS a FROM d, range({EACH}) r(i) WHERE kind < 2)"""


@query("parse_code", f"""WITH {_CODE_FILES} SELECT repo_name, file_path, 'function' AS chunk_type, CAST(a AS INT) AS start_line, CAST(a + 2 AS INT) AS end_line, [name] AS symbols, []::VARCHAR[] AS dependencies, []::VARCHAR[] AS required_interfaces,
md5(CASE kind WHEN 0 THEN 'local function ' || name || '(a)' || chr(10) || '    return ' || callee || '(a)' || chr(10) || 'end' ELSE 'int ' || name || '(int a) {{' || chr(10) || '    return ' || callee || '(a);' || chr(10) || '}}' END) AS digest FROM fn
UNION ALL SELECT repo_name, file_path, 'mds_service', 1, 1, ['dep' || doc_id % 5 || '/[>=1.0]', 'src1', 'if.' || doc_id % 9], ['dep' || doc_id % 5 || '/[>=1.0]', 'src1'], ['if.' || doc_id % 9],
md5('{{"name": "s' || doc_id || '", "version": "1.0", "dependencies": [{{"name": "dep' || doc_id % 5 || '/[>=1.0]"}}, "src1"], "required": [{{"interface": "if.' || doc_id % 9 || '"}}]}}') FROM d WHERE kind = 2""")
def parse_code(spark, sf):
    """Functions of Lua and C files and service descriptions, one file for each document."""
    out = code_chunks(spark, sf)
    return out.select("repo_name", "file_path", "chunk_type", "start_line", "end_line", F.transform("symbols", lambda s: s["name"]).alias("symbols"), "dependencies", "required_interfaces", F.md5("content").alias("digest"))


def text_files(spark, sf):
    """A file for each document: Markdown with front matter, models, commands, types, or broken JSON, by its id."""
    docs = C.table(spark, sf, "documents").select("doc_id", F.col("source").alias("repo_name"))
    id_, kind = F.col("doc_id").cast("string"), F.col("doc_id") % 5
    of = lambda *parts: F.concat(*(id_ if p is None else F.lit(p) for p in parts))
    content = (
        F.when(kind == 0, of('---\ntitle: "T', None, '"\ndate: 2024-01-02\n---\n# A', None, "\nSome words of the first section.\n\n## B", None, "\nMore words of the second one.\n"))
        .when(kind == 1, of('{\n  "classes": {\n    "M', None, '": {\n      "properties": {"P": {}}\n    }\n  }\n}'))
        .when(kind == 2, of('{"cmds": {"G', None, '": {"netfn": "0x30", "cmd": 17}}}'))
        .when(kind == 3, of('{"defs": {"T', None, '": {"type": "enum"}, "U', None, '": {"low": 1}}}'))
        .otherwise(of("not { json, but more than thirty characters ", None))
    )
    path = F.when(kind == 0, of("guide/", None, ".md")).when(kind == 1, of("m", None, "/model.json")).when(kind == 2, of("m", None, "/ipmi.json")).when(kind == 3, of("m", None, "/types.json")).otherwise(of("m/", None, ".json"))
    return docs.select("repo_name", path.alias("file_path"), content.alias("content"))


_TEXT_FILES = r"""d AS (SELECT doc_id, doc_id::VARCHAR AS i, source AS repo_name, doc_id % 5 AS kind FROM documents),
t AS (SELECT repo_name, 'guide/' || i || '.md' AS file_path, 'doc_section' AS chunk_type, 5 AS start_line, 9 AS end_line, ['A' || i] AS symbols, '# A' || i || chr(10) || 'Some words of the first section.' || chr(10) || chr(10) || '## B' || i || chr(10) || 'More words of the second one.' AS content, 'doc_date' AS k, '2024-01-02' AS v FROM d WHERE kind = 0
UNION ALL SELECT repo_name, 'guide/' || i || '.md', 'doc_section', 8, 9, ['B' || i], '## B' || i || chr(10) || 'More words of the second one.', 'doc_date', '2024-01-02' FROM d WHERE kind = 0
UNION ALL SELECT repo_name, 'm' || i || '/model.json', 'mds_model', 3, 5, ['M' || i, 'P'], '{' || chr(10) || '  "M' || i || '": {' || chr(10) || '    "properties": {' || chr(10) || '      "P": {}' || chr(10) || '    }' || chr(10) || '  }' || chr(10) || '}', 'mds_class', 'M' || i FROM d WHERE kind = 1
UNION ALL SELECT repo_name, 'm' || i || '/ipmi.json', 'mds_ipmi_cmd', 1, 1, ['G' || i], '{' || chr(10) || '  "G' || i || '": {' || chr(10) || '    "netfn": "0x30",' || chr(10) || '    "cmd": 17' || chr(10) || '  }' || chr(10) || '}', 'netfn', '0x30' FROM d WHERE kind = 2
UNION ALL SELECT repo_name, 'm' || i || '/types.json', 'mds_type_def', 1, 1, ['T' || i], '{' || chr(10) || '  "T' || i || '": {' || chr(10) || '    "type": "enum"' || chr(10) || '  }' || chr(10) || '}', 'type_kind', 'enum' FROM d WHERE kind = 3
UNION ALL SELECT repo_name, 'm' || i || '/types.json', 'mds_type_def', 1, 1, ['U' || i], '{' || chr(10) || '  "U' || i || '": {' || chr(10) || '    "low": 1' || chr(10) || '  }' || chr(10) || '}', 'type_kind', 'struct' FROM d WHERE kind = 3
UNION ALL SELECT repo_name, 'm/' || i || '.json', 'config_block', 1, 1, []::VARCHAR[], 'not { json, but more than thirty characters ' || i, NULL, NULL FROM d WHERE kind = 4)"""


@query("parse_texts", f"WITH {_TEXT_FILES} SELECT repo_name, file_path, chunk_type, CAST(start_line AS INT) AS start_line, CAST(end_line AS INT) AS end_line, symbols, md5(content) AS digest, v AS said FROM t WHERE length(trim(content)) >= 30")
def parse_texts(spark, sf):
    """Sections of Markdown, models, commands and types of JSON, and files that can't be parsed, one file for each document."""
    out = files.long_enough(parsers.parse(files.wanted(text_files(spark, sf))))
    said = F.coalesce(*(F.col("metadata")[k] for k in ("doc_date", "mds_class", "netfn", "type_kind")))
    return out.select("repo_name", "file_path", "chunk_type", "start_line", "end_line", F.transform("symbols", lambda s: s["name"]).alias("symbols"), F.md5("content").alias("digest"), said.alias("said"))


_CODE_EDGES = f"""{_CODE_FILES}, f AS (SELECT DISTINCT repo_name, file_path, kind, doc_id FROM d), e AS (SELECT *, repo_name || ':' || file_path || ':' AS pre FROM fn),
ce AS (SELECT repo_name || ':' || file_path AS src, repo_name AS dst, 'BELONGS_TO' AS edge_type FROM f
UNION SELECT repo_name || ':' || file_path, pre || name, 'CONTAINS' FROM e UNION SELECT repo_name, pre || name, 'DEFINES' FROM e UNION SELECT pre || name, pre || callee, 'CALLS' FROM e
UNION SELECT repo_name, 'iface:if.' || doc_id % 9, 'REQUIRES_IFACE' FROM f WHERE kind = 2 UNION SELECT f.repo_name, 'src1', 'DEPENDS_ON' FROM f WHERE kind = 2 AND EXISTS (SELECT 1 FROM f WHERE repo_name = 'src1'))"""


def code_graph(spark, sf):
    """Chunks, nodes and edges of the files made from the documents."""
    chunks = code_chunks(spark, sf)
    modules = chunks.select(F.col("file_path").alias("module"), F.col("repo_name").alias("component")).distinct()
    nodes = stored(G.nodes(chunks), "code-nodes")
    return chunks, nodes, stored(G.sound(G.structure(chunks).unionByName(G.imports(chunks, modules)).unionByName(G.calls(chunks)), nodes), "code-edges")


@query("graph_code", f"WITH {_CODE_EDGES} SELECT * FROM ce")
def graph_code(spark, sf):
    """The graph of those files: every function belongs to its file and component and calls the next, services require interfaces."""
    return code_graph(spark, sf)[2]


#: Queries over that graph: each asks for the repository of its first result and names a function.
_WALK = f"""{_CODE_EDGES}, res AS (SELECT i AS query_id, 1 AS rank, repo_name, file_path FROM (SELECT row_number() OVER (ORDER BY doc_id) AS i, * FROM d WHERE kind = 0) WHERE i <= 20),
txt AS (SELECT query_id, 'f_' || regexp_extract(file_path, '([0-9]+)', 1) || '_3' AS t FROM res),
sd AS (SELECT query_id, repo_name AS node_id, 0.8::DOUBLE AS score FROM res UNION ALL SELECT query_id, repo_name || ':' || file_path || ':' || 'f_' || regexp_extract(file_path, '([0-9]+)', 1) || '_' || j, 0.5::DOUBLE FROM res, range(3) x(j)
  UNION ALL SELECT query_id, pre || name, 0.3::DOUBLE FROM txt JOIN e ON e.name = t),
seeds AS (SELECT query_id, node_id, round(max(score), 6) AS score FROM sd GROUP BY ALL)"""


def walked(spark, sf):
    """Results of twenty queries (the first Lua files), their texts, and the graph."""
    chunks, nodes, edges = code_graph(spark, sf)
    nth = F.row_number().over(Window.orderBy("doc_id"))
    first = code_files(spark, sf).where("doc_id % 3 = 0").select("doc_id", "repo_name", "file_path").orderBy("doc_id").limit(20).withColumn("query_id", nth)
    id_ = F.col("doc_id").cast("string")
    name = lambda k: F.concat(F.lit("f_"), id_, F.lit(f"_{k}"))
    results = stored(first.select("query_id", F.lit(1).alias("rank"), "repo_name", "file_path", F.array(*(name(k) for k in range(EACH))).alias("symbol_names"), name(3).alias("text")), "walk-results")
    return results, chunks, nodes, edges


@query("graph_seeds", f"WITH {_WALK} SELECT * FROM seeds")
def graph_seeds(spark, sf):
    """Seeds of results and query texts: components, the first three symbols of a result, entities that a query names."""
    results, _, nodes, _ = walked(spark, sf)
    return G.seeds(results.drop("text"), results.select("query_id", "text"), nodes)


@query("graph_results", f"""WITH {_WALK}, own AS (SELECT query_id, node_id, score FROM seeds WHERE contains(node_id, ':')),
hit AS (SELECT query_id, e.repo_name, e.file_path, e.i, max(score) AS score FROM own JOIN e ON own.node_id = e.pre || e.name GROUP BY ALL),
rnk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, i) AS rank FROM hit)
SELECT query_id, file_path, CAST(4 * i + 1 AS INT) AS start_line, score, 'graph' AS source FROM rnk""")
def graph_results(spark, sf):
    """Seeds as results: the chunks of the entities among them."""
    results, chunks, nodes, _ = walked(spark, sf)
    seen = G.seeds(results.drop("text"), results.select("query_id", "text"), nodes)
    none = chunks.select(F.lit(0).alias("query_id"), "chunk_id").limit(0)
    return G.to_results(seen, nodes, none).join(chunks.select("chunk_id", "file_path", "start_line"), "chunk_id").select("query_id", "file_path", "start_line", "score", "source")


@query("event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf):
    return windowed(C.table(spark, sf, "events"))
