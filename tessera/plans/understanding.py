"""Queries of query understanding, over the benchmark items and a few fixed texts that use its words."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import lexicon as L
from tessera.functions import text as X
from tessera.operators import query as Q
from tessera.plans import corpus as C
from tessera.plans.registry import query

TEXTS = [
    (-1, "传感器阈值配置 sensor"), (-2, "如何初始化 power mgmt 的服务入口"), (-3, "sensr threshold confg"), (-4, "if (x == 1) { return app:get_data() }"), (-5, "component dependency of json model"),
    (-6, "mds"), (-7, "c++ function for ipmi command csr"), (-8, "where is the python handler documented"), (-9, "数据读取 日志 sel 事件"), (-10, "main startup of fan ctrl dev"),
]
VALUES = ", ".join(f"({i}, '{t}')" for i, t in TEXTS)
SQL_Q = f"q AS (SELECT CAST(item_id AS BIGINT) AS query_id, text FROM benchmark UNION ALL SELECT CAST(a AS BIGINT), b FROM (VALUES {VALUES}) v(a, b))"


def asked(spark, sf):
    return C.queries(spark, sf).unionByName(spark.createDataFrame(TEXTS, "query_id long, text string"))


def _case(table: dict[str, list[str]]) -> str:
    """The last key one of whose words the lower-cased text holds."""
    return "coalesce(" + ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in ws) + f" THEN '{k}' END" for k, ws in reversed(list(table.items()))) + ")"


_DEP = X.DEPENDENCY_QUERY


@query("query_flags", rf"""WITH {SQL_Q} SELECT query_id, regexp_matches(text, '[{{}}()\[\];=<>!&|+\-*/\\]|::|\.\w+\(|\bfunction\b|\bclass\b|\blocal\b|\breturn\b|\bimport\b|\brequire\b') AS is_code,
regexp_matches(text, '[一-鿿]') AS has_cjk, regexp_matches(text, '{_DEP}') AS is_dependency, regexp_matches(text, '(?i)入口|初始化|启动|startup|initialize|entry.?point|main\s|app\s') AS is_entry FROM q""")
def query_flags(spark, sf):
    return Q.flags(asked(spark, sf)).drop("text")


@query("query_filters", f"WITH {SQL_Q} SELECT query_id, {_case(L.LANGUAGE_WORDS)} AS filter_language, {_case(L.TYPE_WORDS)} AS filter_chunk_type FROM q")
def query_filters(spark, sf):
    return Q.filters(asked(spark, sf)).drop("text")


_STOP = ", ".join(f"'{w}'" for w in L.STOP_WORDS)


@query("query_keywords", rf"WITH {SQL_Q} SELECT query_id, list_filter(regexp_extract_all(text, '[a-zA-Z_][\p{{L}}\p{{N}}_]*|[一-鿿]+'), lambda w: length(w) > 1 AND lower(w) NOT IN ({_STOP})) AS keywords FROM q")
def query_keywords(spark, sf):
    return Q.keywords(asked(spark, sf)).drop("text")


@query("query_clean", rf"WITH {SQL_Q} SELECT query_id, coalesce(nullif(regexp_replace(replace(replace(replace(replace(text, 'csr', ''), 'json', ''), 'mds', ''), 'sr', ''), '^\s+|\s+$', '', 'g'), ''), text) AS cleaned FROM q")
def query_clean(spark, sf):
    return asked(spark, sf).select("query_id", X.clean_query(F.col("text")).alias("cleaned"))


_TERMS = ", ".join(
    [f"CASE WHEN contains(text, '{zh}') AND NOT contains(lower(text), '{en}') THEN '{en}' END" for zh, words in L.ZH_EN.items() for en in words.split()]
    + [f"CASE WHEN list_contains(w, '{a}') AND NOT contains(lower(text), '{b}') THEN '{b}' END" for a, b in L.ABBREVIATIONS.items()]
    + [f"CASE WHEN contains(lower(text), '{a}') AND NOT contains(text, '{b}') THEN '{b}' END" for a, b in L.EN_ZH.items()]
)


@query("query_expand", rf"""WITH {SQL_Q}, t AS (SELECT query_id, text, regexp_extract_all(lower(text), '[a-zA-Z_][\p{{L}}\p{{N}}_]*') AS w FROM q),
e AS (SELECT query_id, text, list_sort(list_distinct(list_filter([{_TERMS}], lambda x: x IS NOT NULL))) AS expansion FROM t)
SELECT query_id, expansion, CASE WHEN len(expansion) > 0 THEN text || ' ' || array_to_string(expansion, ' ') ELSE text END AS expanded FROM e""")
def query_expand(spark, sf):
    """Without the spelling check, which has a query of its own."""
    return Q.expand(asked(spark, sf), spelling=False).drop("text")


@query("spell_correct")
def spell_correct(spark, sf):
    return Q.corrections(asked(spark, sf))


def _body(name: str) -> str:
    """The SQL of a query of this module after its queries, as a table."""
    from tessera.plans.registry import ORACLES

    return ORACLES[name].removeprefix(f"WITH {SQL_Q}").strip()


@query("query_process", f"""WITH {SQL_Q}, flags AS ({_body('query_flags')}), filters AS ({_body('query_filters')}), words AS ({_body('query_keywords')}), clean AS ({_body('query_clean')}),
wider AS (WITH {_body('query_expand').removeprefix(',')})
SELECT * FROM q JOIN flags USING (query_id) JOIN filters USING (query_id) JOIN words USING (query_id) JOIN clean USING (query_id) JOIN wider USING (query_id)""")
def query_process(spark, sf):
    """All that is known of a query, but for the spelling check."""
    return Q.process(asked(spark, sf), spelling=False)
