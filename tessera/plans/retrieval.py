"""Queries of the sparse and dense paths and of fusing, boosting and evaluating ranked lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import boost as boosts
from tessera.operators import dense, evaluate, fusion, sparse
from tessera.plans import corpus as C
from tessera.plans.registry import query
from tessera.sources.scratch import small

# ---------------------------------------------------------------- tokens and statistics


@query("tokenize_stats", f"WITH {C.SQL_DOCS} SELECT chunk_id, CAST(len(toks) AS INT) AS n_tokens, CAST(len(list_distinct(toks)) AS INT) AS n_distinct, md5(array_to_string(toks, ' ')) AS digest FROM docs")
def tokenize_stats(spark, sf):
    docs, _ = C.tokenized(spark, sf)
    return docs.select("chunk_id", F.size("tokens").alias("n_tokens"), F.size(F.array_distinct("tokens")).alias("n_distinct"), F.md5(F.array_join("tokens", " ")).alias("digest"))


@query("postings", f"WITH {C.SQL_POSTINGS} SELECT chunk_id, token, CAST(tf AS BIGINT) AS tf FROM post")
def postings(spark, sf):
    return sparse.postings(C.tokenized(spark, sf)[0])


@query("corpus_stats", f"WITH {C.SQL_POSTINGS} SELECT CAST(n AS BIGINT) AS n, round(avgdl, 6) AS avgdl, round((SELECT 0.25 * avg(r) FROM raw), 6) AS floor FROM stats")
def corpus_stats(spark, sf):
    s = sparse.corpus_stats(sparse.term_rows(C.tokenized(spark, sf)[0]))
    return s.select("n", F.round("avgdl", 6).alias("avgdl"), F.round("floor", 6).alias("floor"))


@query("term_stats", f"WITH {C.SQL_POSTINGS} SELECT token, CAST(df AS BIGINT) AS df, round(idf, 6) AS idf FROM terms")
def term_stats(spark, sf):
    terms = sparse.term_rows(C.tokenized(spark, sf)[0])
    return sparse.term_stats(terms, sparse.corpus_stats(terms)).select("token", "df", F.round("idf", 6).alias("idf"))


@query("bm25_topk", f"WITH {C.SQL_BM25}, {C.sql_ranked('scored', 10, 'top')} SELECT query_id, chunk_id, score, CAST(rank AS INT) AS rank, 'bm25' AS source FROM top")
def bm25_topk(spark, sf):
    docs, asked = C.tokenized(spark, sf)
    return sparse.ranked(sparse.scores(docs, asked), 10, source="bm25")


# The grid of parameters.
GRID_K1, GRID_B = (0.5, 0.8, 1.0, 1.2, 1.5, 1.8, 2.0, 2.5, 3.0), (0.0, 0.15, 0.3, 0.5, 0.6, 0.75, 0.9, 1.0)
_GRID = f"params AS (SELECT * FROM (VALUES {', '.join(f'({x}::DOUBLE)' for x in GRID_K1)}) a(k1), (VALUES {', '.join(f'({x}::DOUBLE)' for x in GRID_B)}) c(b))"


@query("bm25_grid", f"""WITH {_GRID}, {C.sql_bm25('k1', 'b', 'k1, b')}, {C.sql_ranked('scored', 5, 'top', 'k1, b, query_id')},
gold AS (SELECT item_id AS query_id, doc_id AS chunk_id FROM benchmark JOIN documents d ON contains(d.text, benchmark.text)),
hit AS (SELECT k1, b, query_id FROM top JOIN gold USING (query_id, chunk_id) GROUP BY ALL)
SELECT k1, b, CAST(count(query_id) AS BIGINT) AS hits, round(count(query_id) / (SELECT count(DISTINCT query_id) FROM gold)::DOUBLE, 6) AS file_at_5 FROM params LEFT JOIN hit USING (k1, b) GROUP BY k1, b""")
def bm25_grid(spark, sf):
    """Hits at 5 for every pair of parameters, from one pass over the postings."""
    docs, asked = C.tokenized(spark, sf)
    pairs = [(k, b) for k in GRID_K1 for b in GRID_B]
    params, top = spark.createDataFrame(pairs, "k1 double, b double"), sparse.grid(docs, asked, pairs, 5)
    gold = planted(spark, sf).select("query_id", "chunk_id")
    hit = top.join(gold, ["query_id", "chunk_id"]).select("k1", "b", "query_id").distinct()
    n = gold.agg(F.countDistinct("query_id").alias("n"))
    counted = params.join(hit.groupBy("k1", "b").agg(F.count(F.lit(1)).alias("hits")), ["k1", "b"], "left")
    return counted.join(F.broadcast(n)).select("k1", "b", F.coalesce("hits", F.lit(0)).alias("hits"), F.round(F.coalesce("hits", F.lit(0)) / F.col("n"), 6).alias("file_at_5"))


def holders(texts, items):
    """(query_id, chunk_id): the texts (chunk_id, content) that hold an item's text (query_id, item) as a whole.

    A text that holds an item holds the item's inner words as words. So each item is looked for by its longest
    inner word, by a join, and only what has that word is compared. Items without an inner word are few and
    short; they are held against every text in blocks of what may be broadcast.
    """
    words = F.split("item", r"\s+")
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.char_length(w).alias("n"), w.alias("w"))))["w"]
    items = items.where("item is not null").withColumn("anchor", longest)
    spoken = texts.select("chunk_id", F.explode(F.array_distinct(F.split("content", r"\s+"))).alias("anchor"))
    met = spoken.join(items.select("query_id", "anchor").where("anchor is not null"), "anchor").select("query_id", "chunk_id")
    found = texts.join(met, "chunk_id").join(items.select("query_id", "item"), "query_id").where(F.contains("content", F.col("item"))).select("query_id", "chunk_id")
    short = items.where("anchor is null").select("query_id", "item")
    if not short.limit(1).count():
        return found
    return found.unionByName(texts.join(small(short, 100_000)(short), F.contains("content", F.col("item"))).select("query_id", "chunk_id"))


def planted(spark, sf):
    """Which documents hold which benchmark text."""
    items = C.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("item"))
    ch = C.chunks(spark, sf)
    return holders(ch.select("chunk_id", "content"), items).join(ch.select("chunk_id", "repo_name", "file_path", "language"), "chunk_id").select("query_id", "chunk_id", "repo_name", "file_path", "language")


# ---------------------------------------------------------------- dense
@query("dense_topk", f"WITH {C.SQL_DENSE}, {C.sql_ranked('dscored', 10, 'top')} SELECT query_id, chunk_id, score, CAST(rank AS INT) AS rank FROM top")
def dense_topk(spark, sf):
    v, q = C.vectors(spark, sf)
    return dense.nearest(v, q, 10)


@query("dense_filtered", f"WITH {C.SQL_DENSE}, f AS (SELECT * FROM dscored WHERE label IN (1, 3, 5)), {C.sql_ranked('f', 10, 'top')} SELECT query_id, chunk_id, score, CAST(rank AS INT) AS rank FROM top")
def dense_filtered(spark, sf):
    """The filter reaches the scan before any distance is computed."""
    v, q = C.vectors(spark, sf)
    return dense.nearest(v, q, 10, F.col("label").isin(1, 3, 5))


# ---------------------------------------------------------------- fusion: chunks are texts and vectors of one id
HYBRID = f"""{C.SQL_BM25}, {C.sql_ranked('scored', 30, 'sparse')}, {C.SQL_ITEM_DENSE}, {C.sql_ranked('dense0', 30, 'dense')}"""
_RRF = """fused AS (SELECT query_id, chunk_id, CAST(d.rank AS INT) AS dense_rank, CAST(s.rank AS INT) AS sparse_rank,
  round(coalesce({wd} / (60 + d.rank), 0.0::DOUBLE) + coalesce({ws} / (60 + s.rank), 0.0::DOUBLE), 9) AS score FROM dense d FULL JOIN sparse s USING (query_id, chunk_id){join})"""
_FUSED = _RRF.format(wd="0.5::DOUBLE", ws="0.5::DOUBLE", join="")
_FINAL = "CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank"
RANKED_FUSED = f"{HYBRID}, {_FUSED}, ranked AS (SELECT *, {_FINAL} FROM fused)"


def lists(spark, sf, k: int = 30):
    """The dense and sparse list of each item."""
    docs, asked = C.tokenized(spark, sf)
    return dense.nearest(C.vectors(spark, sf)[0], C.item_vectors(spark, sf), k), sparse.ranked(sparse.scores(docs, asked), k)


@query("rrf_fuse", f"WITH {RANKED_FUSED} SELECT query_id, chunk_id, dense_rank, sparse_rank, score, rank FROM ranked")
def rrf_fuse(spark, sf):
    return fusion.rrf(*lists(spark, sf))


_CODE = r"""code AS (SELECT item_id AS query_id, regexp_matches(text, '[{}()\[\];=<>!&|+\-*/\\]|::|\.\w+\(|\bfunction\b|\bclass\b|\blocal\b|\breturn\b|\bimport\b|\brequire\b') OR length(text) < 150 AS is_code FROM benchmark)"""


@query("rrf_code_weights", f"""WITH {_CODE}, {HYBRID}, {_RRF.format(wd="(CASE WHEN coalesce(is_code, false) THEN greatest(0.5::DOUBLE - 0.15::DOUBLE, 0.1) ELSE 0.5 END)", ws="(CASE WHEN coalesce(is_code, false) THEN 0.5::DOUBLE + 0.15::DOUBLE ELSE 0.5 END)", join=" LEFT JOIN code USING (query_id)")}
SELECT query_id, chunk_id, dense_rank, sparse_rank, score, {_FINAL} FROM fused""")
def rrf_code_weights(spark, sf):
    """Code-like queries (here also the short ones, so that both kinds occur) lean to the sparse list."""
    d, s = lists(spark, sf)
    code = C.queries(spark, sf).select("query_id", (F.col("text").rlike(X.CODE_QUERY) | (F.char_length("text") < 150)).alias("is_code"))
    return fusion.rrf(d, s, code=code)


@query("docs_rrf", f"""WITH {HYBRID}, nd AS (SELECT query_id, max(rank) + 1 AS nd FROM dense GROUP BY 1), ns AS (SELECT query_id, max(rank) + 1 AS ns FROM sparse GROUP BY 1),
fused AS (SELECT query_id, chunk_id, round(1 / (60 + coalesce(d.rank, nd, 1))::DOUBLE + 1 / (60 + coalesce(s.rank, ns, 1))::DOUBLE, 9) AS score
  FROM dense d FULL JOIN sparse s USING (query_id, chunk_id) LEFT JOIN nd USING (query_id) LEFT JOIN ns USING (query_id)) SELECT *, {_FINAL} FROM fused""")
def docs_rrf(spark, sf):
    return fusion.rrf_docs(*lists(spark, sf))


@query("rerank_signal", f"""WITH {RANKED_FUSED}, outer_list AS (SELECT query_id, chunk_id, rank AS r FROM sparse),
added AS (SELECT query_id, chunk_id, dense_rank, sparse_rank, round(score + coalesce(0.4::DOUBLE / (60 + r), 0), 9) AS score FROM ranked LEFT JOIN outer_list USING (query_id, chunk_id)) SELECT *, {_FINAL} FROM added""")
def rerank_signal(spark, sf):
    d, s = lists(spark, sf)
    return fusion.add_signal(fusion.rrf(d, s), s)


@query("minmax_blend", f"""WITH {RANKED_FUSED}, ext AS (SELECT query_id, chunk_id, score AS e FROM sparse WHERE rank <= 20),
lohi AS (SELECT query_id, min(e) AS lo, max(e) AS hi FROM ext GROUP BY 1), span AS (SELECT query_id, min(score) AS a, max(score) AS z FROM ranked GROUP BY 1),
mixed AS (SELECT query_id, chunk_id, rank AS before, CASE WHEN lo IS NULL THEN score ELSE
  round(0.6 * (score - a) / (CASE WHEN z > a THEN z - a ELSE 1 END) + 0.4 * coalesce((e - lo) / (CASE WHEN hi > lo THEN hi - lo ELSE 1 END), 0), 6) END AS score
  FROM ranked JOIN span USING (query_id) LEFT JOIN lohi USING (query_id) LEFT JOIN ext USING (query_id, chunk_id))
SELECT query_id, chunk_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, before) AS INT) AS rank FROM mixed""")
def minmax_blend(spark, sf):
    """The first 20 of the sparse list stand for an outer reranker's scores."""
    d, s = lists(spark, sf)
    fused = fusion.rrf(d, s).withColumnRenamed("rank", "before")
    mixed = fusion.blend(fused.withColumn("rank", F.col("before")), s.where("rank <= 20"))
    return fusion.rerank(mixed.withColumn("score", F.round("score", 6)), then=("before",)).select("query_id", "chunk_id", "score", "rank")


@query("diversity_penalty", f"""WITH {C.SQL_CHUNKS}, {RANKED_FUSED}, nth AS (SELECT r.*, file_path, row_number() OVER (PARTITION BY query_id, file_path ORDER BY rank) AS n FROM ranked r JOIN chunks USING (chunk_id)),
cut AS (SELECT query_id, chunk_id, file_path, rank AS before, CASE WHEN n > 3 THEN round(score * 0.5, 9) ELSE score END AS score FROM nth)
SELECT query_id, chunk_id, file_path, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before) AS INT) AS rank FROM cut""")
def diversity_penalty(spark, sf):
    fused = fusion.rrf(*lists(spark, sf)).join(C.chunks(spark, sf).select("chunk_id", "file_path"), "chunk_id")
    return fusion.diversify(fused).select("query_id", "chunk_id", "file_path", "score", "rank")


@query("inject_candidates", f"""WITH {RANKED_FUSED}, base AS (SELECT query_id, chunk_id, rank, score FROM ranked WHERE rank <= 20), extra AS (SELECT query_id, chunk_id, rank, score FROM dense),
fresh AS (SELECT * FROM (SELECT e.*, row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id) AS i FROM extra e ANTI JOIN base USING (query_id, chunk_id)) WHERE i <= 3),
added AS (SELECT query_id, count(*) AS n FROM fresh GROUP BY 1), sizes AS (SELECT query_id, count(*) AS len FROM base GROUP BY 1)
SELECT query_id, chunk_id, CAST(rank + CASE WHEN rank > 5 THEN coalesce(n, 0) ELSE 0 END AS BIGINT) AS rank, score, false AS injected FROM base LEFT JOIN added USING (query_id)
UNION ALL SELECT query_id, chunk_id, CAST(least(5, coalesce(len, 0)) + i AS BIGINT), score, true FROM fresh LEFT JOIN sizes USING (query_id)""")
def inject_candidates(spark, sf):
    d, s = lists(spark, sf)
    out = fusion.inject(fusion.rrf(d, s).where("rank <= 20"), d, at=5)
    return out.withColumn("rank", F.col("rank").cast("long"))


# ---------------------------------------------------------------- boosts
_SYMBOLS = f"list_filter({C.sql_tokens('content')}, lambda t: length(t) >= 8)"
_DEP = X.DEPENDENCY_QUERY.removeprefix("(?i)")


def boosted(spark, sf):
    names = F.filter(X.tokens(F.col("content")), lambda t: F.char_length(t) >= 8)
    ch = C.chunks(spark, sf).withColumn("symbol_names", names).withColumn("mds_class", F.get("symbol_names", F.lit(0))).drop("content")
    q = C.queries(spark, sf).select("query_id", F.concat(F.col("text"), F.lit(" interface of src3 de.txt")).alias("query"))
    top = sparse.ranked(sparse.scores(*C.tokenized(spark, sf)), 30)
    return boosts.boost(top.withColumn("score", F.round(F.col("score") / 1000, 9)).join(ch, "chunk_id").join(small(q, 100_000)(q), "query_id"))


def sql_boosted(top: str, q: str, score: str) -> str:
    """CTEs up to s: top (query_id, chunk_id, before, score) with all boosts for the lower-cased queries q (query_id, q). Needs chunks."""
    return rf"""bq AS (SELECT *, list_distinct(regexp_extract_all(q, '[a-zA-Z_][\p{{L}}\p{{N}}_]*')) AS t FROM {q} lq),
c AS (SELECT *, {_SYMBOLS} AS symbols, split_part(split_part(file_path, '/', -1), '.', 1) AS name, list_distinct(list_filter(regexp_split_to_array(file_path, '[/_.-]'), lambda p: p <> '')) AS parts FROM chunks SEMI JOIN {top} lt USING (chunk_id)),
r AS (SELECT query_id, chunk_id, before, {score} AS score, q, t, symbols, repo_name, file_path, chunk_type, name, parts,
  list_filter(symbols, lambda s: contains(q, s) OR len(list_filter(t, lambda x: length(x) >= 3 AND contains(s, x))) > 0) AS named,
  len(list_filter(parts, lambda p: list_contains(t, p) OR contains(q, p))) AS hits FROM {top} lt JOIN c USING (chunk_id) JOIN bq USING (query_id)),
b AS (SELECT *, CASE WHEN len(named) = 0 THEN 0 WHEN trim(q) = named[1] THEN 0.025 ELSE 0.008 END::DOUBLE AS symbol_bonus,
  CASE WHEN contains(q, repo_name) THEN 0.006 WHEN len(list_filter(t, lambda x: length(x) >= 3 AND contains(repo_name, x))) > 0 THEN 0.006::DOUBLE * 0.8::DOUBLE ELSE 0 END::DOUBLE AS repo_bonus,
  CASE WHEN contains(q, file_path) THEN 0.006 WHEN list_contains(t, name) AND (contains(name, '_') OR length(name) >= 8) THEN 0.02 WHEN hits >= 2 THEN 0.006 WHEN hits = 1 THEN 0.006::DOUBLE * 0.8::DOUBLE ELSE 0 END::DOUBLE AS path_bonus,
  CASE WHEN coalesce(symbols[1], '') <> '' AND contains(q, symbols[1]) THEN 0.012 ELSE 0 END::DOUBLE AS model_bonus,
  CASE WHEN chunk_type = 'mds_service' AND regexp_matches(q, '{_DEP}', 'i') THEN 0.010 ELSE 0 END::DOUBLE AS service_bonus FROM r),
s AS (SELECT query_id, chunk_id, symbol_bonus, repo_bonus, path_bonus, model_bonus, service_bonus, before, round(score + symbol_bonus + repo_bonus + path_bonus + model_bonus + service_bonus, 9) AS score FROM b)"""


BOOST_SQL = f"""WITH {C.SQL_CHUNKS}, {C.SQL_BM25}, {C.sql_ranked('scored', 30, 'top')},
{sql_boosted('(SELECT query_id, chunk_id, rank AS before, score FROM top)', "(SELECT item_id AS query_id, lower(text || ' interface of src3 de.txt') AS q FROM benchmark)", 'round(score / 1000, 9)')}
SELECT query_id, chunk_id, symbol_bonus, repo_bonus, path_bonus, model_bonus, service_bonus, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before) AS INT) AS rank FROM s"""


@query("boost_scores", BOOST_SQL)
def boost_scores(spark, sf):
    return boosted(spark, sf).select("query_id", "chunk_id", "symbol_bonus", "repo_bonus", "path_bonus", "model_bonus", "service_bonus", "score", "rank")


@query("ce_heuristic", rf"""WITH {C.SQL_BM25}, {C.sql_ranked('scored', 20, 'top')},
q AS (SELECT item_id AS query_id, list_filter(list_distinct(regexp_extract_all(lower(text), '[a-zA-Z_][\p{{L}}\p{{N}}_]*')), lambda t: length(t) > 1) AS w FROM benchmark),
s AS (SELECT query_id, chunk_id, round(0.7 * score + 0.3 * (len(list_filter(w, lambda t: contains(lower(d.text), t))) / greatest(len(w), 1)::DOUBLE), 9) AS score FROM top JOIN q USING (query_id) JOIN documents d ON d.doc_id = chunk_id)
SELECT *, {_FINAL} FROM s""")
def ce_heuristic(spark, sf):
    """Texts join only the ranked rows, after the cut."""
    top = sparse.ranked(sparse.scores(*C.tokenized(spark, sf)), 20)
    rows = top.join(C.chunks(spark, sf).select("chunk_id", "content"), "chunk_id")
    return fusion.overlap_scores(rows, C.queries(spark, sf)).select("query_id", "chunk_id", "score", "rank")


# ---------------------------------------------------------------- evaluation
GOLD = "gold AS (SELECT DISTINCT item_id AS case_id, source AS repo_name, source || '/' || lang || '.txt' AS file_path, CASE WHEN lang = 'en' THEN 3 WHEN lang = 'de' THEN 2 ELSE 1 END AS relevance FROM benchmark JOIN documents d ON contains(d.text, benchmark.text))"
EVAL = f"""{C.SQL_CHUNKS}, {C.SQL_BM25}, {C.sql_ranked('scored', 10, 'top')}, {GOLD},
res AS (SELECT query_id AS case_id, rank, repo_name, file_path FROM top JOIN chunks USING (chunk_id)),
hit AS (SELECT r.case_id, r.rank, r.repo_name || ':' || g.file_path AS key, relevance FROM res r JOIN gold g ON g.case_id = r.case_id AND g.repo_name = r.repo_name AND ends_with(r.file_path, g.file_path)),
firsts AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY rank, key) AS nth FROM (SELECT case_id, key, min(rank) AS rank, max(relevance) AS relevance FROM hit GROUP BY ALL)),
best AS (SELECT case_id, count(*) AS n, sum(CASE WHEN p <= 5 THEN relevance / log2(p + 1) END) AS i5, sum(CASE WHEN p <= 10 THEN relevance / log2(p + 1) END) AS i10
  FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY relevance DESC, repo_name, file_path) AS p FROM gold) GROUP BY 1),
h AS (SELECT case_id, {', '.join(f'max(CAST(rank <= {k} AS INT)) AS f{k}' for k in (1, 3, 5, 10))}, min(rank) AS one, sum(CASE WHEN rank <= 5 THEN relevance / log2(rank + 1) END) AS g5, sum(CASE WHEN rank <= 10 THEN relevance / log2(rank + 1) END) AS g10 FROM hit GROUP BY 1),
u AS (SELECT case_id, {', '.join(f'sum(CAST(rank <= {k} AS INT)) AS u{k}' for k in (1, 3, 5, 10))}, sum(nth / rank::DOUBLE) AS ap, sum(CASE WHEN rank <= 5 THEN relevance / log2(rank + 1) END) AS d5, sum(CASE WHEN rank <= 10 THEN relevance / log2(rank + 1) END) AS d10 FROM firsts GROUP BY 1),
cases AS (SELECT item_id AS case_id, CASE WHEN length(text) < 150 THEN 'short' WHEN length(text) < 220 THEN 'medium' ELSE 'long' END AS difficulty, CASE WHEN contains(text, chr(10)) THEN 'lines' ELSE 'line' END AS category FROM benchmark),
m AS (SELECT case_id, difficulty, category, {', '.join(f'coalesce(f{k}, 0) AS file_at_{k}' for k in (1, 3, 5, 10))}, {', '.join(f'round(coalesce(u{k} / {k}::DOUBLE, 0), 6) AS precision_at_{k}, round(coalesce(u{k} / n::DOUBLE, 0), 6) AS recall_at_{k}' for k in (1, 3, 5, 10))},
  CASE WHEN n IS NOT NULL THEN round(coalesce(1 / one::DOUBLE, 0), 6) END AS rr, round(coalesce(ap / n, 0), 6) AS ap, {', '.join(f'round(coalesce(g{k} / i{k}, 0), 6) AS ndcg_raw_at_{k}, round(coalesce(d{k} / i{k}, 0), 6) AS ndcg_at_{k}' for k in (5, 10))}
  FROM cases LEFT JOIN h USING (case_id) LEFT JOIN u USING (case_id) LEFT JOIN best USING (case_id))"""
_LONG = "long AS (UNPIVOT (SELECT * FROM m2) ON " + ", ".join(evaluate.METRICS) + " INTO NAME metric VALUE x)"
_M2 = "m2 AS (SELECT case_id, difficulty, category, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in evaluate.METRICS) + " FROM m)"


def evaluated(spark, sf):
    """Cases, the ranked files of the sparse path, and the files that hold the case's text."""
    top = sparse.ranked(sparse.scores(*C.tokenized(spark, sf)), 10)
    ch = C.chunks(spark, sf).select("chunk_id", "repo_name", "file_path")
    results = top.join(ch, "chunk_id").withColumnRenamed("query_id", "case_id")
    relevance = F.when(F.col("language") == "en", 3).when(F.col("language") == "de", 2).otherwise(1)
    expected = planted(spark, sf).select(F.col("query_id").alias("case_id"), "repo_name", "file_path", relevance.alias("relevance")).distinct()
    n = F.char_length("text")
    cases = C.queries(spark, sf).select(F.col("query_id").alias("case_id"), F.when(n < 150, "short").when(n < 220, "medium").otherwise("long").alias("difficulty"), F.when(F.contains("text", F.lit("\n")), "lines").otherwise("line").alias("category"))
    return cases, results, expected


@query("eval_case_metrics", f"WITH {EVAL} SELECT * FROM m")
def eval_case_metrics(spark, sf):
    return evaluate.case_metrics(*evaluated(spark, sf))


@query("relevance_match", f"WITH {EVAL} SELECT case_id, CAST(rank AS INT) AS rank, key, relevance FROM hit")
def relevance_match(spark, sf):
    _, results, expected = evaluated(spark, sf)
    return evaluate.matches(results, expected)


@query("eval_summary", f"WITH {EVAL}, {_M2}, {_LONG} SELECT 'all' AS dim, 'all' AS value, metric, round(avg(x), 6) AS score FROM long GROUP BY metric")
def eval_summary(spark, sf):
    return evaluate.summary(evaluate.case_metrics(*evaluated(spark, sf)))


@query("eval_breakdown", f"""WITH {EVAL}, {_M2}, long AS (SELECT * FROM m2 UNPIVOT INCLUDE NULLS (x FOR metric IN ({', '.join(evaluate.METRICS)})))
SELECT CASE WHEN grouping(difficulty) = 0 THEN 'difficulty' WHEN grouping(category) = 0 THEN 'category' ELSE 'all' END AS dim, coalesce(difficulty, category, 'all') AS value, metric, round(avg(x), 6) AS score, CAST(count(*) AS BIGINT) AS cases
FROM long GROUP BY GROUPING SETS ((metric), (difficulty, metric), (category, metric))""")
def eval_breakdown(spark, sf):
    return evaluate.summary(evaluate.case_metrics(*evaluated(spark, sf)), ["difficulty", "category"])


@query("bootstrap_ci", f"""WITH {EVAL}, no AS (SELECT row_number() OVER (ORDER BY case_id) - 1 AS no, count(*) OVER () AS n, * FROM m),
draws AS (SELECT i, j, n, CAST('0x' || substr(md5('42:' || i || ':' || j), 1, 12) AS BIGINT) % n AS no FROM range(1000) a(i), (SELECT unnest(range(1, n + 1)) AS j, n FROM (SELECT max(n) AS n FROM no))),
means AS (SELECT i, round(avg(file_at_5::DOUBLE), 9) AS file_at_5, round(avg(rr), 9) AS rr, round(avg(ap), 9) AS ap FROM draws JOIN no USING (no) GROUP BY i),
long AS (UNPIVOT means ON file_at_5, rr, ap INTO NAME metric VALUE x), o AS (SELECT metric, x, row_number() OVER (PARTITION BY metric ORDER BY x, i) - 1 AS r FROM long)
SELECT metric, max(CASE WHEN r = 25 THEN x END) AS lower, max(CASE WHEN r = 975 THEN x END) AS upper FROM o GROUP BY metric""")
def bootstrap_ci(spark, sf):
    return evaluate.bootstrap(evaluate.case_metrics(*evaluated(spark, sf)), ["file_at_5", "rr", "ap"])


@query("metric_delta", f"""WITH {EVAL}, {_M2}, {_LONG}, a AS (SELECT metric, round(avg(x), 6) AS before FROM long GROUP BY 1), z AS (SELECT metric, round(avg(x), 6) AS after FROM long WHERE difficulty = 'long' GROUP BY 1)
SELECT metric, before, after, round(after - before, 6) AS delta FROM a JOIN z USING (metric)""")
def metric_delta(spark, sf):
    m = evaluate.case_metrics(*evaluated(spark, sf))
    return evaluate.delta(evaluate.summary(m), evaluate.summary(m.where("difficulty = 'long'")))


@query("label_hits", f"""WITH {C.SQL_CHUNKS}, {C.SQL_BM25}, {C.sql_ranked('scored', 5, 'top')}, want AS (SELECT item_id AS case_id, CASE WHEN length(text) < 220 THEN ['de', 'fr'] ELSE [] END AS expected FROM benchmark),
seen AS (SELECT query_id AS case_id, list(language) AS l FROM top JOIN chunks USING (chunk_id) GROUP BY 1) SELECT case_id, len(expected) = 0 OR coalesce(list_has_any(expected, l), false) AS hit FROM want LEFT JOIN seen USING (case_id)""")
def label_hits(spark, sf):
    top = sparse.ranked(sparse.scores(*C.tokenized(spark, sf)), 5).join(C.chunks(spark, sf).select("chunk_id", "language"), "chunk_id")
    found = top.select(F.col("query_id").alias("case_id"), "rank", F.array("language").alias("labels"))
    cases = C.queries(spark, sf).select(F.col("query_id").alias("case_id"), F.when(F.char_length("text") < 220, F.array(F.lit("de"), F.lit("fr"))).otherwise(F.array().cast("array<string>")).alias("expected"))
    return evaluate.label_hits(cases, found, "expected", "labels", 5).select("case_id", "hit")
