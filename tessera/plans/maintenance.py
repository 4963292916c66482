"""Queries of components, files, incremental upkeep, conversations and judging."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.config import IngestConfig
from tessera.functions import text as X
from tessera.operators import agent, components, incremental
from tessera.plans import corpus as C
from tessera.plans.registry import query
from tessera.sources import files, parsers

SQL_SYMBOLS = f"""sym AS (SELECT *, list_transform(list_filter({C.sql_tokens('content')}, lambda t: length(t) >= 8), lambda t: {{'name': t, 'kind': CASE WHEN length(t) % 2 = 0 THEN 'function' ELSE 'class' END}}) AS symbols FROM chunks)"""


def with_symbols(spark, sf):
    names = F.filter(X.tokens(F.col("content")), lambda t: F.char_length(t) >= 8)
    kind = lambda t: F.when(F.char_length(t) % 2 == 0, "function").otherwise("class")
    return C.chunks(spark, sf).withColumn("symbols", F.transform(names, lambda t: F.struct(t.alias("name"), kind(t).alias("kind"))))


@query("component_stats", f"""WITH {C.SQL_CHUNKS}, {SQL_SYMBOLS} SELECT coalesce(nullif(component_name, ''), repo_name) AS component, count(DISTINCT file_path) AS files, list_sort(list(DISTINCT language)) AS languages,
CAST(sum(len(list_filter(symbols, lambda s: s.kind = 'function'))) AS BIGINT) AS functions, CAST(sum(len(list_filter(symbols, lambda s: s.kind = 'class'))) AS BIGINT) AS classes, count(*) AS chunks FROM sym GROUP BY 1""")
def component_stats(spark, sf):
    return components.component_stats(with_symbols(spark, sf))


@query("component_symbols", f"""WITH {C.SQL_CHUNKS}, {SQL_SYMBOLS} SELECT component, s.name AS name, s.kind AS kind, count(*) AS n FROM (SELECT coalesce(nullif(component_name, ''), repo_name) AS component, unnest(symbols) AS s FROM sym) GROUP BY ALL""")
def component_symbols(spark, sf):
    return components.component_symbols(with_symbols(spark, sf))


@query("component_chunks", f"WITH {C.SQL_CHUNKS} SELECT chunk_id, file_path FROM chunks WHERE repo_name = 'src3' AND chunk_type = 'mds_service'")
def component_chunks(spark, sf):
    return components.of_component(C.chunks(spark, sf), "src3", "mds_service").select("chunk_id", "file_path")


@query("component_deps", """WITH c AS (SELECT doc_id, source, CASE WHEN n_chars < 1000 THEN 'mds_model' WHEN n_chars < 2000 THEN 'mds_ipmi_cmd' WHEN n_chars < 4000 THEN 'file' ELSE 'mds_service' END AS chunk_type, lang, 'n' || doc_id AS name FROM documents)
SELECT source AS component, max_by([lang || '-lib', source || '-core'], doc_id) FILTER (chunk_type = 'mds_service') AS dependencies, max_by(['if.' || lang], doc_id) FILTER (chunk_type = 'mds_service') AS required_interfaces,
coalesce(list_sort(list(name) FILTER (chunk_type = 'mds_model')), []) AS models, coalesce(list_sort(list(name) FILTER (chunk_type = 'mds_ipmi_cmd')), []) AS commands FROM c GROUP BY source""")
def component_deps(spark, sf):
    n = F.col("n_chars")
    kind = F.when(n < 1000, "mds_model").when(n < 2000, "mds_ipmi_cmd").when(n < 4000, "file").otherwise("mds_service")
    rows = C.table(spark, sf, "documents").select(
        F.col("source").alias("component_name"), F.col("source").alias("repo_name"), kind.alias("chunk_type"), F.col("doc_id").alias("ord"),
        F.array(F.struct(F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("name"))).alias("symbols"),
        F.array(F.concat("lang", F.lit("-lib")), F.concat("source", F.lit("-core"))).alias("dependencies"), F.array(F.concat(F.lit("if."), "lang")).alias("required_interfaces"),
    )
    return components.component_dependencies(rows)


@query("index_stats", f"WITH {C.SQL_CHUNKS} SELECT language AS collection, count(*) AS chunks, count(DISTINCT file_path) AS files, count(DISTINCT repo_name) AS repos FROM chunks GROUP BY 1")
def index_stats(spark, sf):
    return components.index_stats(C.chunks(spark, sf).withColumn("collection", F.col("language")))


@query("chunk_lookup", f"WITH {C.SQL_CHUNKS} SELECT chunk_id, language, file_path FROM chunks WHERE chunk_id IN (SELECT item_id FROM benchmark)")
def chunk_lookup(spark, sf):
    ch = C.chunks(spark, sf).select("chunk_id", "language", "file_path")
    ids = C.table(spark, sf, "benchmark").select(F.col("item_id").alias("chunk_id")).distinct()
    return components.lookup([ch.where("language = 'en'"), ch], ids)


@query("total_files", f"WITH {C.SQL_CHUNKS} SELECT CAST(sum(f) AS BIGINT) AS files FROM (SELECT count(DISTINCT file_path) AS f FROM chunks GROUP BY repo_name)")
def total_files(spark, sf):
    return component_stats(spark, sf).agg(F.sum("files").alias("files"))


# ---------------------------------------------------------------- files
PATHS = [
    ("r1", "src/a.lua"), ("r1", "build/x.lua"), ("r1", "src/build/y.c"), ("r1", "src/rebuild/z.cpp"), ("r1", "README.md"), ("r1", "a.py"), ("r2", "tests/t.lua"), ("r2", "mds/service.json"), ("r2", "IMG.PNG"), ("r2", "deep/images/i.json"),
    ("r2", "x.min.json"), ("r2", "keep/log/a.md"), ("r2", "log/b.md"), ("docs", "guide/intro.md"), ("docs", "noext"),
]
IGNORE = ["# rules", "*.min.json", "/log/", "!keep/"]


@query("file_filter", f"""WITH p AS (SELECT 'doc/' || source || '/' || doc_id || CASE lang WHEN 'en' THEN '.lua' WHEN 'de' THEN '.cpp' WHEN 'fr' THEN '.py' ELSE '.MD' END AS file_path, source AS repo_name FROM documents
UNION ALL SELECT b, a FROM (VALUES {', '.join(f"('{a}', '{b}')" for a, b in PATHS)}) v(a, b)),
l AS (SELECT *, CASE lower(regexp_extract(file_path, '(\\.[^./]+)$', 1)) WHEN '.lua' THEN 'lua' WHEN '.c' THEN 'c' WHEN '.h' THEN 'c' WHEN '.cpp' THEN 'cpp' WHEN '.hpp' THEN 'cpp' WHEN '.cc' THEN 'cpp' WHEN '.cxx' THEN 'cpp' WHEN '.json' THEN 'json' WHEN '.md' THEN 'markdown' END AS language FROM p)
SELECT repo_name, file_path, language, CASE WHEN repo_name = 'docs' THEN 'docs' ELSE 'code' END AS collection FROM l
WHERE language IS NOT NULL AND NOT ({' OR '.join(f"starts_with(file_path, '{x}') OR contains(file_path, '/{x}')" for x in IngestConfig().exclude)}) AND NOT regexp_matches(file_path, '(^|/)[^/]*\\.min\\.json(/|$)') AND NOT (regexp_matches(file_path, '^log/') AND NOT regexp_matches(file_path, '(^|/)keep/'))""")
def file_filter(spark, sf):
    ext = F.when(F.col("lang") == "en", ".lua").when(F.col("lang") == "de", ".cpp").when(F.col("lang") == "fr", ".py").otherwise(".MD")
    rows = C.table(spark, sf, "documents").select(F.col("source").alias("repo_name"), F.concat(F.lit("doc/"), "source", F.lit("/"), F.col("doc_id").cast("string"), ext).alias("file_path"))
    rows = rows.unionByName(spark.createDataFrame(PATHS, "repo_name string, file_path string"))
    return files.wanted(rows, ignore=IGNORE).withColumn("collection", files.collection(F.col("repo_name")))


@query("split_by_lines", r"""WITH l AS (SELECT doc_id, regexp_split_to_array(regexp_replace(coalesce(text, ''), '(\r\n|\n|\r)$', ''), '\r\n|\n|\r') AS l FROM documents),
w AS (SELECT doc_id, l, unnest(range(0, greatest(len(l), 1), 15)) AS s FROM l)
SELECT doc_id, CAST(s + 1 AS INT) AS start_line, CAST(least(s + 20, len(l)) AS INT) AS end_line, md5(array_to_string(l[s + 1:s + 20], chr(10))) AS digest FROM w WHERE trim(array_to_string(l[s + 1:s + 20], ''), ' ' || chr(9) || chr(10) || chr(13)) <> ''""")
def split_by_lines(spark, sf):
    """Windows of 20 lines that overlap by 5."""
    rows = C.table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("content"))
    out = parsers.line_windows(rows, IngestConfig(window_lines=20, overlap=5))
    return out.select("doc_id", "start_line", "end_line", F.md5("content").alias("digest"))


# ---------------------------------------------------------------- upkeep: the old state lacks French, has an extra file and changed Spanish texts
_KEY = "source || ':' || source || '/' || lang || '/' || (doc_id // 512) || '.txt' AS file_key"
_OLD = f"SELECT {_KEY}, md5(string_agg(CASE WHEN lang = 'es' AND source < 'src3' THEN text || '!' ELSE text END, chr(10) ORDER BY doc_id)) AS o FROM documents WHERE lang <> 'fr' GROUP BY ALL UNION ALL SELECT 'gone:x.txt', md5('a')"
_NEW = f"SELECT {_KEY}, md5(string_agg(text, chr(10) ORDER BY doc_id)) AS n FROM documents GROUP BY ALL"
_DIFF = f"""old AS ({_OLD}), new AS ({_NEW}),
diff AS (SELECT file_key, CASE WHEN o IS NULL THEN 'added' WHEN n IS NULL THEN 'deleted' WHEN o <> n THEN 'changed' ELSE 'unchanged' END AS state FROM old FULL JOIN new USING (file_key))"""


def states(spark, sf):
    new = C.file_chunks(spark, sf).select("chunk_id", "repo_name", "file_path", "language", "content")
    changed = (F.col("language") == "es") & (F.col("repo_name") < "src3")
    old = new.where("language <> 'fr'").withColumn("content", F.when(changed, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    gone = spark.createDataFrame([("gone", "x.txt", "en", "a")], "repo_name string, file_path string, language string, content string").select(F.lit(-1).cast("long").alias("chunk_id"), "*")
    return old.unionByName(gone), new


@query("file_checksums", f"WITH {_DIFF} SELECT file_key, n AS md5 FROM new")
def file_checksums(spark, sf):
    return incremental.file_checksums(C.file_chunks(spark, sf))


@query("checksum_diff", f"WITH {_DIFF} SELECT file_key, state FROM diff WHERE file_key <> 'gone:x.txt' UNION ALL SELECT 'gone:x.txt', 'deleted'")
def checksum_diff(spark, sf):
    old, new = states(spark, sf)
    return incremental.checksum_diff(incremental.file_checksums(old), incremental.file_checksums(new))


@query("incremental_upsert", "SELECT doc_id AS chunk_id, source AS repo_name, lang AS language, md5(text) AS digest FROM documents")
def incremental_upsert(spark, sf):
    old, new = states(spark, sf)
    diff = incremental.checksum_diff(incremental.file_checksums(old), incremental.file_checksums(new))
    return incremental.upsert(old, new, diff).select("chunk_id", "repo_name", "language", F.md5("content").alias("digest"))


# ---------------------------------------------------------------- conversations and judging
@query("history_trim", """SELECT conv_id, turn, role, CASE WHEN role = 'tool' AND length(text) > 2000 THEN substr(text, 1, 2000) || '... [truncated]' ELSE text END AS text
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 40""")
def history_trim(spark, sf):
    """The last 40 messages, tool outputs cut at 2,000 characters."""
    return agent.trim_history(C.table(spark, sf, "conversations"))


@query("history_trim_short", """SELECT conv_id, turn, role, CASE WHEN role = 'tool' AND length(text) > 200 THEN substr(text, 1, 200) || '... [truncated]' ELSE text END AS text
FROM (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'tool' ELSE role END AS role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 4""")
def history_trim_short(spark, sf):
    """With limits that the conversations at hand exceed, and the users' messages as tool outputs, so that both cuts occur."""
    rows = C.table(spark, sf, "conversations")
    return agent.trim_history(rows.withColumn("role", F.when(F.col("role") == "user", "tool").otherwise(F.col("role"))), 4, 200)


@query("last_answer", "SELECT conv_id, max_by(text, turn) AS answer, max(turn) AS turn FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def last_answer(spark, sf):
    return agent.last_answer(C.table(spark, sf, "conversations"))


@query("judge_summary", """WITH m AS (SELECT doc_id, lang, CAST(doc_id % 11 AS INT) AS accuracy, CAST(5 + 5 * quality AS INT) AS completeness, CAST(10 - 8 * toxic AS INT) AS evidence, CAST(doc_id % 7 AS INT) AS clarity, quality + toxic AS tool_calls,
  CASE WHEN quality = 0 AND toxic = 1 THEN 'timeout' END AS error FROM labels JOIN documents USING (doc_id)),
w AS (SELECT *, round(0.3 * accuracy + 0.25 * completeness + 0.25 * evidence + 0.2 * clarity, 6)::DOUBLE AS weighted FROM m WHERE error IS NULL)
SELECT lang, round(avg(accuracy), 6) AS accuracy, round(avg(completeness), 6) AS completeness, round(avg(evidence), 6) AS evidence, round(avg(clarity), 6) AS clarity, round(avg(weighted), 6) AS weighted,
  round(avg(CAST(weighted >= 6.0 AS INT)), 6) AS pass_rate, round(avg(tool_calls), 6) AS tool_calls, round(1 - avg(evidence) / 10, 6) AS hallucination, count(*) AS cases FROM w GROUP BY lang""")
def judge_summary(spark, sf):
    """The judge's reply is written as JSON in a fence, in prose or bare, and read back."""
    rows = C.table(spark, sf, "labels").join(C.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    marks = F.to_json(F.struct((F.col("doc_id") % 11).alias("accuracy"), (5 + 5 * F.col("quality")).alias("completeness"), (10 - 8 * F.col("toxic")).alias("evidence"), (F.col("doc_id") % 7).alias("clarity")))
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("```json\n"), marks, F.lit("\n```"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("Here it is: "), marks, F.lit(" as asked."))).otherwise(marks)
    rows = rows.withColumn("raw", raw).withColumn("error", F.when((F.col("quality") == 0) & (F.col("toxic") == 1), "timeout")).withColumn("tool_calls", F.col("quality") + F.col("toxic"))
    return agent.judge_summary(agent.judged(rows), ["lang"])


#: Replies of a judge, and the four marks that are to be read from each.
REPLIES = [
    ('```json\n{"accuracy": 8, "completeness": 7, "evidence": 9, "clarity": 6}\n```', (8, 7, 9, 6)), ('I think {"accuracy": 3, "clarity": 10} is fair', (3, 0, 0, 10)), ("no json here", (0, 0, 0, 0)), ("", (0, 0, 0, 0)),
    ('{"accuracy": 10, "completeness": 10, "evidence": 10, "clarity": 10}', (10, 10, 10, 10)),
]
_REPLIES = ", ".join(f"({i}, replace('{t.replace(chr(10), '#LF#')}', '#LF#', chr(10)), {', '.join(map(str, m))})" for i, (t, m) in enumerate(REPLIES))


@query("judge_parse", f"""SELECT CAST(i AS INT) AS case_id, raw, CAST(a AS INT) AS accuracy, CAST(c AS INT) AS completeness, CAST(e AS INT) AS evidence, CAST(k AS INT) AS clarity, round(0.3 * a + 0.25 * c + 0.25 * e + 0.2 * k, 6)::DOUBLE AS weighted,
0.3 * a + 0.25 * c + 0.25 * e + 0.2 * k >= 6 AS passed FROM (VALUES {_REPLIES}) v(i, raw, a, c, e, k)""")
def judge_parse(spark, sf):
    return agent.judged(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(REPLIES)], "case_id int, raw string"))


@query("tool_context", "WITH t AS (SELECT conv_id, turn, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '...' ELSE text END AS t FROM conversations WHERE role = 'user') SELECT conv_id, CAST(count(*) AS INT) AS tool_calls, string_agg(t, chr(10) || '---' || chr(10) ORDER BY turn, t) AS context FROM t GROUP BY conv_id")
def tool_context(spark, sf):
    """The users' messages stand for tool outputs, which the conversations at hand lack."""
    rows = C.table(spark, sf, "conversations").withColumn("role", F.when(F.col("role") == "user", "tool").otherwise(F.col("role")))
    return agent.contexts(rows, 80)


# ---------------------------------------------------------------- parsers over a small tree of files
def sample_files(spark):
    lua = "local class = require 'mc.class'\nlocal Fan = class(base_app)\n\n" + "\n".join(f"function Fan:step{i}(n)\n    for _, f in ipairs(self.fans) do\n        speed_{i}(f, n)\n    end\nend\n" for i in range(4)) + "\nlocal function speed_1(f, n)\n    return f.rpm * n\nend\n\nreturn Fan\n"
    c = '#include "bus/wire.h"\n\ntypedef struct reading {\n    int raw;\n} reading_t;\n\nint read_raw(int line) {\n    if (line < 0) {\n        return -1;\n    }\n    return line * 2;\n}\n\nint read_twice(int line) {\n    return read_raw(line) + read_raw(line);\n}\n'
    md = "---\ntitle: \"Fan guide\"\ndate: 2024-01-02\n---\n# Fans\nHow fans are run.\n\n## Speed\nSet a speed.\n```\n# not a heading\n```\n### Limits\nNone.\n##### Deep\nHidden.\n# End\nThat is all of it.\n"
    service = '{\n  "name": "fan",\n  "version": "2.1",\n  "dependencies": {"build": ["bus/[>=1.0]", {"conan": "wire/1.2"}], "test": ["probe/0.1"]},\n  "required": ["if.Speed", {"interface": "if.Alarm"}]\n}'
    model = '{\n  "classes": {\n    "Fan": {\n      "properties": {"Rpm": {}, "Id": {}}\n    },\n    "Rack": {\n      "properties": {}\n    }\n  }\n}'
    ipmi = '{\n  "cmds": {\n    "GetFan": {\n      "netfn": "0x30",\n      "cmd": 17\n    }\n  }\n}'
    types = '{\n  "defs": {\n    "Mode": {\n      "type": "enum"\n    },\n    "Span": {\n      "low": 1\n    }\n  }\n}'
    rows = [("fan", "src/fan_app.lua", lua), ("wire", "src/read.c", c), ("docs", "fans.md", md), ("fan", "mds/service.json", service), ("fan", "mds/model.json", model), ("fan", "mds/ipmi.json", ipmi), ("fan", "mds/types.json", types),
            ("fan", "broken.json", "not { json, but more than thirty characters"), ("fan", "small.lua", "return 1"), ("wire", "src/bus.lua", "local fan = require('fan.core')\nlocal function speed_2(f, n)\n    return read_raw(f)\nend\nreturn speed_2\n")]
    return spark.createDataFrame(rows, "repo_name string, file_path string, content string")


def parsed(spark):
    return files.long_enough(parsers.parse(files.wanted(sample_files(spark))))


@query("parse_files")
def parse_files(spark, sf):
    out = parsed(spark)
    return out.select("repo_name", "file_path", "chunk_type", "start_line", "end_line", F.transform("symbols", lambda s: s["name"]).alias("symbols"), "dependencies", "required_interfaces", "chunk_id")


@query("page_sections", r"""WITH p AS (SELECT page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS title, regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1) AS parts, url FROM pages)
SELECT page_id, title, CAST(len(parts) AS INT) AS parts, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM p""")
def page_sections(spark, sf):
    return C.table(spark, sf, "pages").select(
        "page_id", F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit("(?s)<p>(.*?)</p>"), F.lit(1))).alias("parts"),
        F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"),
    )
