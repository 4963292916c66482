"""The search pipeline as one plan for many queries, its modes and its presets."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import Bm25Config, SearchConfig
from tessera.functions import lexicon as L
from tessera.functions import text as X
from tessera.operators import boost, components, dense, evaluate, fusion, graph, query, sparse
from tessera.plans import corpus as C
from tessera.plans import retrieval as R
from tessera.plans import understanding as U
from tessera.plans.registry import query as registered
from tessera.sources.scratch import small, stored

MODES = ("bm25_only", "dense_only", "hybrid", "reranked", "cross_encoder", "outer_reranker", "full")
#: Columns of chunks that a search may be filtered by.
FILTERS = ("language", "repo_name", "chunk_type")
#: Queries whose columns are broadcast to their candidates; more are joined by a shuffle.
BROADCAST_QUERIES = 100_000

Scorer = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass
class Engine:
    """The tables a search reads: chunks, their tokens and vectors (chunk_id, embedding).

    Models are arguments; what they don't score falls back to the way without them.
    rerank(candidates, queries) gives outer scores (query_id, chunk_id, score): it sees `rerank_most` candidates
    of a query at most, and its best `rerank_top` count. cross(rows, queries) gives a cross-encoder's scores of
    rows with contents; a query of which it leaves out a candidate is scored by word overlap. rewrite(queries)
    gives rewritten queries (query_id, text, embedding); those of under three characters, or that say the same
    as before, are not searched.
    """

    chunks: DataFrame
    tokens: DataFrame
    vectors: DataFrame
    config: SearchConfig = SearchConfig()
    bm25: Bm25Config = Bm25Config()
    rerank: Scorer | None = None
    cross: Scorer | None = None
    rewrite: Callable[[DataFrame], DataFrame] | None = None
    #: Whether words of a query that name a language or kind of chunk filter its results.
    infer_filters: bool = True
    #: Whether misspelt words are held against known terms, and which, if not those of the lexicon.
    spelling: bool = True
    known_terms: tuple[str, ...] | None = None

    def processed(self, queries: DataFrame) -> tuple[DataFrame, set[str]]:
        """The queries with all that is known of them, worked out once, and which of the optional steps any of them needs.

        Columns language, repo_name and chunk_type of the queries filter the results and override what their
        words say; a column is_code, or what a column intent classifies as code or not, overrides what they look like.
        """
        if "intent" in queries.columns:
            hint = query.intent_hint(F.col("intent"))
            queries = queries.withColumn("is_code", F.coalesce(F.col("is_code"), hint) if "is_code" in queries.columns else hint)
        own = {c: c in queries.columns for c in (*FILTERS, "is_code")}
        given = queries.select(*[c for c in queries.columns if not own.get(c)], *(F.col(c).alias(f"_{c}") for c, x in own.items() if x))
        asked = query.process(given, spelling=self.spelling, known=None if self.known_terms is None else list(self.known_terms))
        none = F.lit(None).cast("string")
        said = lambda c: F.col(f"_{c}") if own[c] else none
        inferred = {c: F.col(f"filter_{c}") if self.infer_filters and c != "repo_name" else none for c in FILTERS}
        asked = asked.withColumns({f"filter_{c}": F.coalesce(said(c), inferred[c]) for c in FILTERS})
        if own["is_code"]:
            asked = asked.withColumn("is_code", F.coalesce("_is_code", "is_code"))
        asked = stored(asked.drop(*(f"_{c}" for c in own)), "queries")
        needs = {"service": F.col("is_dependency"), "entry": F.col("is_entry")} | {c: F.col(f"filter_{c}").isNotNull() for c in FILTERS}
        row = asked.agg(*(F.coalesce(F.max(x), F.lit(False)).alias(c) for c, x in needs.items())).first()
        return asked, {c for c in needs if row[c]}

    def candidates(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Processed queries, dense list, sparse list, after all injections."""
        cfg, depth = self.config, 3 * k
        asked, steps = self.processed(queries)
        hint = small(asked, BROADCAST_QUERIES)
        by = tuple(c for c in FILTERS if c in steps)
        vectors, wanted = self.vectors, asked.select("query_id", "embedding", *(f"filter_{c}" for c in by))
        found = sparse.scores(self.tokens, asked.select("query_id", X.tokens(F.col("expanded")).alias("tokens")), self.bm25)
        if by:
            # before the cut to depth, so that a query whose filter few chunks pass still gets its list
            kinds = self.chunks.select("chunk_id", *by)
            vectors = vectors.join(kinds, "chunk_id", "left")
            if cfg.filter_scope == "all":
                found = found.join(hint(wanted.drop("embedding")), "query_id").join(kinds, "chunk_id", "left").where(self.passes(by)).select("query_id", "chunk_id", "score")
        d, s = dense.nearest(vectors, wanted, depth, match=by), sparse.ranked(found, depth)
        if self.rewrite is not None:
            said = asked.select("query_id", F.lower("text").alias("_text"))
            again = self.rewrite(asked).join(said, "query_id").where((F.char_length(F.trim("text")) >= 3) & (F.lower("text") != F.col("_text")))
            d = fusion.inject(d, dense.nearest(self.vectors, again.select("query_id", "embedding"), 2 * k), cfg.inject_sparse_at, cfg.inject_rows)
        if "service" in steps:
            service = self.chunks.where("chunk_type = 'mds_service'").select("chunk_id")
            extra = dense.nearest(self.vectors.join(service, "chunk_id", "left_semi"), asked.where("is_dependency").select("query_id", "embedding"), 10)
            d, s = fusion.inject(d, extra, cfg.inject_dense_at, cfg.inject_rows), fusion.inject(s, extra.withColumn("score", F.lit(10.0)), cfg.inject_sparse_at, cfg.inject_rows)
        if "entry" in steps:
            entry = self.chunks.where(F.col("file_path").rlike(X.ENTRY_FILE)).select("chunk_id")
            doors = dense.nearest(self.vectors.join(entry, "chunk_id", "left_semi"), asked.where("is_entry").select("query_id", "embedding"), 20)
            d = fusion.inject(d, doors, cfg.inject_dense_at, cfg.inject_rows)
        return asked, d, s

    @staticmethod
    def passes(by: tuple[str, ...] = FILTERS) -> Column:
        """Whether a chunk passes a query's filters."""
        ok = F.lit(True)
        for c in by:
            ok = ok & (F.col(f"filter_{c}").isNull() | (F.col(c) == F.col(f"filter_{c}")))
        return ok

    def search(self, queries: DataFrame, top_k: int | None = None, mode: str = "full", language: str | None = None, repo: str | None = None, chunk_type: str | None = None, is_code: bool | None = None) -> DataFrame:
        """(query_id, chunk_id, rank, score, source) of each query's results in one of MODES.

        queries: query_id, text, embedding. Filters and is_code may be given for all of them, or as their
        columns (see `processed`).
        """
        if mode not in MODES:
            raise ValueError(f"no mode is named {mode}")
        k = self.config.clamp(top_k)
        for c, x in zip((*FILTERS, "is_code"), (language, repo, chunk_type, is_code)):
            queries = queries if x is None else queries.withColumn(c, F.lit(x))
        if mode == "bm25_only":
            found = sparse.scores(self.tokens, queries.select("query_id", X.tokens(F.col("text")).alias("tokens")), self.bm25)
            return sparse.ranked(found, k, source="bm25").select("query_id", "chunk_id", "rank", "score", "source")
        if mode == "dense_only":
            return dense.nearest(self.vectors, queries, k).withColumn("source", F.lit("dense")).select("query_id", "chunk_id", "rank", "score", "source")
        asked, d, s = self.candidates(queries, k)
        fused = fusion.rrf(d, s, self.config, asked)
        names = self.chunks.drop("content", "rank", "score")
        if mode != "hybrid":
            fused = fused.where(F.col("rank") <= 3 * k)
        rows = fused.select("query_id", "chunk_id", "rank", "score").join(names, "chunk_id")
        if mode in ("reranked", "full", "outer_reranker"):
            rows = boost.boost(rows.join(small(asked, BROADCAST_QUERIES)(asked.select("query_id", F.col("text").alias("query"))), "query_id"))
        if self.rerank is not None and mode in ("full", "outer_reranker"):
            outer = sparse.ranked(self.rerank(rows.where(F.col("rank") <= self.config.rerank_most), asked), self.config.rerank_top)
            rows = fusion.blend(rows, outer, self.config.rerank_alpha)
        source = F.lit("hybrid")
        if mode == "cross_encoder":
            rows, source = self.crossed(rows, asked), F.col("source")
        out = fusion.diversify(rows, most=self.config.max_per_file).where(F.col("rank") <= k)
        return out.select("query_id", "chunk_id", "rank", "score", source.alias("source"))

    def crossed(self, rows: DataFrame, asked: DataFrame) -> DataFrame:
        """Ranked rows by a cross-encoder's scores, or by word overlap where there are none of a query."""
        texts = rows.join(self.chunks.select("chunk_id", "content"), "chunk_id")
        plain = fusion.overlap_scores(texts, asked).drop("content").withColumn("source", F.lit("cross_encoder_fallback"))
        if self.cross is None:
            return plain
        given = self.cross(texts, asked).select("query_id", "chunk_id", F.col("score").alias("_model"))
        both = plain.join(given, ["query_id", "chunk_id"], "left")
        whole = F.count("_model").over(Window.partitionBy("query_id")) == F.count(F.lit(1)).over(Window.partitionBy("query_id"))
        both = both.withColumn("_whole", whole).withColumn("score", F.when(F.col("_whole"), F.col("_model")).otherwise(F.col("score")))
        both = both.withColumn("source", F.when(F.col("_whole"), "cross_encoder").otherwise(F.col("source")))
        return fusion.rerank(both.drop("_model", "_whole", "rank"))

    def raw(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """Both lists as they come: no filters, no injections, no fusion."""
        return self.search(queries, k, "dense_only"), self.search(queries, k, "bm25_only")

    def definitions(self, queries: DataFrame, language: str | None = None) -> DataFrame:
        """queries (query_id, text, embedding, symbol): chunks that define the symbol among the first 20 results, or the first 5."""
        found = self.search(queries, 20, language=language, is_code=True).join(self.chunks.select("chunk_id", "symbol_names"), "chunk_id")
        return components.definitions(found.join(small(queries, BROADCAST_QUERIES)(queries.select("query_id", "symbol")), "query_id"))

    def references(self, queries: DataFrame) -> DataFrame:
        """Where symbols are called or used: 30 results, as code."""
        return self.search(queries, 30, is_code=True)

    def multi(self, queries: DataFrame, k: int = 10, most: int = 5) -> DataFrame:
        """queries with group_id: the first `most` of a group are searched and their results merged by repository, file and first line."""
        nth = F.row_number().over(Window.partitionBy("group_id").orderBy("query_id"))
        own = queries.withColumn("_n", nth).where(F.col("_n") <= most).drop("_n")
        found = self.search(own.drop("group_id"), 2 * k).join(small(own, BROADCAST_QUERIES)(own.select("query_id", "group_id")), "query_id")
        key = [c for c in ("repo_name", "file_path", "start_line") if c in self.chunks.columns]
        return fusion.best_of(found.join(self.chunks.select("chunk_id", *key), "chunk_id"), key, k)

    def docs(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """Search in the documentation: 2k rows a path, fused without weights or boosts; at most 20 results."""
        k = min(k, 20)
        own = self.chunks.where(F.col("collection") == "docs").select("chunk_id")
        found = sparse.scores(self.tokens.join(own, "chunk_id", "left_semi"), queries.select("query_id", X.tokens(F.col("text")).alias("tokens")), self.bm25)
        d = dense.nearest(self.vectors.join(own, "chunk_id", "left_semi"), queries, 2 * k)
        return fusion.rrf_docs(d, sparse.ranked(found, 2 * k), self.config.rrf_k).where(F.col("rank") <= k).withColumn("source", F.lit("docs"))

    def widened(self, results: DataFrame, queries: DataFrame, nodes: DataFrame, edges: DataFrame, k: int = 30) -> DataFrame:
        """Chunks that the results' graph neighbourhood adds: seeds of the results and queries, two steps of decay, callers elsewhere, peers of an interface."""
        top = results.join(self.chunks.select("chunk_id", "repo_name", "file_path", "symbol_names"), "chunk_id")
        seen = stored(graph.seeds(top, queries, nodes), "seeds")
        wide = graph.decay_expand(edges, seen)
        wide = wide.unionByName(graph.cross_calls(edges, nodes, wide)).groupBy("query_id", "node_id").agg(F.max("score").alias("score"))
        return graph.to_results(graph.peers(edges, wide), nodes, results, k)


def symbol_names(content: Column) -> Column:
    """The stand-in symbols of a text: its tokens of eight letters or more."""
    return F.filter(X.tokens(content), lambda t: F.char_length(t) >= 8)


def engine(spark, sf: str) -> tuple[Engine, DataFrame]:
    """The tables at hand as an engine, and its queries with vectors."""
    ch = C.chunks(spark, sf).withColumn("symbol_names", symbol_names(F.col("content"))).withColumn("mds_class", F.get("symbol_names", F.lit(0)))
    asked = C.queries(spark, sf).join(C.item_vectors(spark, sf), "query_id")
    return Engine(ch, C.tokenized(spark, sf)[0], C.vectors(spark, sf)[0].select("chunk_id", "embedding")), asked


THIN_SQL = """named AS (SELECT r.query_id, chunk_id, file_path, r.rank, r.score FROM {source} r JOIN chunks USING (chunk_id)),
nth AS (SELECT *, row_number() OVER (PARTITION BY query_id, file_path ORDER BY rank) AS n FROM named),
cut AS (SELECT query_id, chunk_id, rank AS before, CASE WHEN n > 3 THEN round(score * 0.5, 9) ELSE score END AS score FROM nth),
fin AS (SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before) AS INT) AS rank, score FROM cut)
SELECT query_id, chunk_id, rank, score, 'hybrid' AS source FROM fin WHERE rank <= {k}"""


@registered("search_hybrid", f"WITH {C.SQL_CHUNKS}, {R.RANKED_FUSED}, {THIN_SQL.replace('{source}', 'ranked').replace('{k}', '10')}")
def search_hybrid(spark, sf):
    """Both paths, fused and thinned out."""
    e, asked = engine(spark, sf)
    return replace(e, infer_filters=False).search(asked, 10, "hybrid")


def sql_full(asked: str, k: int, final: str, outer: bool = True, code: str = "is_code") -> str:
    """The whole pipeline. asked: SELECT query_id, text, filter_language, filter_repo_name, filter_chunk_type, is_code over the items."""
    low, depth = "lower(text)", 3 * k
    inject = lambda name, source, extra, at, score: f"""{name}_n AS (SELECT * FROM (SELECT e.*, row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id) AS i FROM {extra} e ANTI JOIN {source} USING (query_id, chunk_id)) WHERE i <= 3),
{name} AS (SELECT query_id, chunk_id, rank + CASE WHEN rank > {at} THEN coalesce(n, 0) ELSE 0 END AS rank FROM {source} LEFT JOIN (SELECT query_id, count(*) AS n FROM {name}_n GROUP BY 1) USING (query_id)
  UNION ALL SELECT query_id, chunk_id, least({at}, coalesce(len, 0)) + i FROM {name}_n LEFT JOIN (SELECT query_id, count(*) AS len FROM {source} GROUP BY 1) USING (query_id))"""  # noqa: E731
    pass_ = " AND ".join(f"(filter_{c} IS NULL OR filter_{c} = c.{c})" for c in FILTERS)
    blended = f"""told AS (SELECT item_id AS query_id, token, count(*) AS qtf FROM (SELECT item_id, unnest({C.sql_tokens('text')}) AS token FROM benchmark) GROUP BY ALL),
told_scores AS (SELECT query_id, chunk_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(toks) / avgdl))), 6) AS e FROM told JOIN terms USING (token) JOIN post USING (token) JOIN docs USING (chunk_id), stats GROUP BY ALL),
ext AS (SELECT * FROM (SELECT t.*, row_number() OVER (PARTITION BY query_id ORDER BY e DESC, chunk_id) AS n FROM told_scores t SEMI JOIN boosted USING (query_id, chunk_id)) WHERE n <= 20),
lohi AS (SELECT query_id, min(e) AS lo, max(e) AS hi FROM ext GROUP BY 1), span AS (SELECT query_id, min(score) AS a, max(score) AS z FROM boosted GROUP BY 1),
mixed AS (SELECT query_id, chunk_id, rank AS before, CASE WHEN lo IS NULL THEN score ELSE round(0.6 * ((score - a) / (CASE WHEN z > a THEN z - a ELSE 1 END)) + (1::DOUBLE - 0.6::DOUBLE) * coalesce((e - lo) / (CASE WHEN hi > lo THEN hi - lo ELSE 1 END), 0), 9) END AS score
  FROM boosted JOIN span USING (query_id) LEFT JOIN lohi USING (query_id) LEFT JOIN ext USING (query_id, chunk_id)),
last AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before) AS rank FROM mixed)"""
    return f"""WITH {C.SQL_CHUNKS}, {C.SQL_POSTINGS}, {C.SQL_ITEM_DENSE}, q0 AS ({asked}),
w0 AS (SELECT query_id, text, regexp_extract_all({low}, '[a-zA-Z_][\\p{{L}}\\p{{N}}_]*') AS w FROM q0),
x0 AS (SELECT query_id, list_sort(list_distinct(list_filter([{U._TERMS}], lambda x: x IS NOT NULL))) AS expansion FROM w0),
q AS (SELECT q0.*, CASE WHEN len(expansion) > 0 THEN text || ' ' || array_to_string(expansion, ' ') ELSE text END AS expanded, regexp_matches(text, '{U._DEP}') AS is_dependency FROM q0 JOIN x0 USING (query_id)),
asked AS (SELECT query_id, token, count(*) AS qtf FROM (SELECT query_id, unnest({C.sql_tokens('expanded')}) AS token FROM q) GROUP BY ALL),
scored0 AS (SELECT query_id, chunk_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(toks) / avgdl))), 6) AS score FROM asked JOIN terms USING (token) JOIN post USING (token) JOIN docs USING (chunk_id), stats GROUP BY ALL),
scored AS (SELECT s.* FROM scored0 s JOIN q USING (query_id) JOIN chunks c USING (chunk_id) WHERE {pass_}), {C.sql_ranked('scored', depth, 's0')},
near0 AS (SELECT d.* FROM dense0 d JOIN q USING (query_id) LEFT JOIN chunks c USING (chunk_id) WHERE {pass_}), {C.sql_ranked('near0', depth, 'd0')},
svc0 AS (SELECT d.* FROM dense0 d JOIN q USING (query_id) JOIN chunks c USING (chunk_id) WHERE is_dependency AND c.chunk_type = 'mds_service'), {C.sql_ranked('svc0', 10, 'svc')},
{inject('d1', 'd0', 'svc', 5, '')}, {inject('s1', 's0', 'svc', 10, '')},
fused0 AS (SELECT query_id, chunk_id, round(coalesce((CASE WHEN {code} THEN greatest(0.5::DOUBLE - 0.15::DOUBLE, 0.1) ELSE 0.5 END) / (60 + d.rank), 0.0::DOUBLE) + coalesce((CASE WHEN {code} THEN 0.5::DOUBLE + 0.15::DOUBLE ELSE 0.5 END) / (60 + s.rank), 0.0::DOUBLE), 9) AS score
  FROM d1 d FULL JOIN s1 s USING (query_id, chunk_id) JOIN q USING (query_id)), {C.sql_ranked('fused0', depth, 'fused')},
{R.sql_boosted('(SELECT query_id, chunk_id, rank AS before, score FROM fused)', '(SELECT query_id, lower(text) AS q FROM q)', 'score')},
boosted AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before) AS rank FROM s), {blended + ', ' if outer else ''}{final.replace('{source}', 'last' if outer else 'boosted').replace('{k}', str(k))}"""


_INFERRED = f"{U._case(L.LANGUAGE_WORDS)} AS filter_language, {U._case(L.TYPE_WORDS)} AS filter_chunk_type"
_CODE = r"regexp_matches(text, '[{}()\[\];=<>!&|+\-*/\\]|::|\.\w+\(|\bfunction\b|\bclass\b|\blocal\b|\breturn\b|\bimport\b|\brequire\b') AS is_code"
_PLAIN = f"SELECT item_id AS query_id, text, {_INFERRED}, NULL::VARCHAR AS filter_repo_name, {_CODE} FROM benchmark"
#: Items ask for a dependency now and then, so that this step occurs.
_ASKED = f"SELECT query_id, text, {_INFERRED}, NULL::VARCHAR AS filter_repo_name, {_CODE} FROM (SELECT item_id AS query_id, CASE WHEN item_id % 4 = 1 THEN text || ' interface dependency' ELSE text END AS text FROM benchmark)"


def full(e: Engine, asked: DataFrame) -> Engine:
    """The engine with the sparse scores of the plain query in an outer reranker's place."""
    outer = sparse.scores(e.tokens, asked.select("query_id", X.tokens(F.col("text")).alias("tokens")))
    return replace(e, spelling=False, rerank=lambda rows, q: outer.join(rows.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_semi"))


@registered("search_full", sql_full(_PLAIN, 10, THIN_SQL))
def search_full(spark, sf):
    """All steps; the sparse scores stand for an outer reranker."""
    e, asked = engine(spark, sf)
    return full(e, asked).search(asked, 10, "full")


@registered("search_reranked", sql_full(_ASKED, 10, THIN_SQL, outer=False))
def search_reranked(spark, sf):
    """Without an outer reranker; items of which every fourth asks for interfaces, which injects service chunks."""
    e, asked = engine(spark, sf)
    asked = asked.withColumn("text", F.when(F.col("query_id") % 4 == 1, F.concat("text", F.lit(" interface dependency"))).otherwise(F.col("text")))
    return replace(e, spelling=False).search(asked, 10, "reranked")


_FILTERED = f"""SELECT item_id AS query_id, text, CASE WHEN item_id % 3 = 0 THEN 'es' ELSE {U._case(L.LANGUAGE_WORDS)} END AS filter_language, CASE WHEN item_id % 2 = 0 THEN 'src3' END AS filter_repo_name,
CASE WHEN item_id % 5 = 0 THEN 'mds_service' ELSE {U._case(L.TYPE_WORDS)} END AS filter_chunk_type, item_id % 7 = 0 AS is_code FROM benchmark"""


@registered("search_filtered", sql_full(_FILTERED, 10, THIN_SQL, outer=False))
def search_filtered(spark, sf):
    """Filters that are given, by language, repository and kind, and the override of what looks like code; every query gets the best of what passes."""
    e, asked = engine(spark, sf)
    i, none = F.col("query_id"), F.lit(None).cast("string")
    own = {"language": F.when(i % 3 == 0, "es").otherwise(none), "repo_name": F.when(i % 2 == 0, "src3").otherwise(none), "chunk_type": F.when(i % 5 == 0, "mds_service").otherwise(none), "is_code": i % 7 == 0}
    return replace(e, spelling=False).search(asked.withColumns(own), 10, "reranked")


@registered("search_raw", f"WITH {R.HYBRID} SELECT query_id, chunk_id, CAST(rank AS INT) AS rank, score, 'dense' AS source FROM dense WHERE rank <= 10 UNION ALL SELECT query_id, chunk_id, CAST(rank AS INT), score, 'bm25' FROM sparse WHERE rank <= 10")
def search_raw(spark, sf):
    e, asked = engine(spark, sf)
    d, s = e.raw(asked, 10)
    return d.unionByName(s)


#: A group of the items: eight of them, of which five are searched.
_GROUPED = _PLAIN.replace("FROM benchmark", "FROM benchmark WHERE item_id % 8 < 5")
_MERGED = THIN_SQL.rpartition("SELECT query_id")[0] + """, found AS (SELECT query_id // 8 AS group_id, query_id, chunk_id, file_path, score FROM fin JOIN chunks USING (chunk_id) WHERE rank <= {k}),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY group_id, file_path ORDER BY score DESC, query_id, chunk_id) AS n FROM found) WHERE n = 1),
top AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY score DESC, chunk_id) AS rank FROM once)
SELECT group_id, query_id, chunk_id, CAST(rank AS INT) AS rank, score FROM top WHERE rank <= 10"""


@registered("search_multi", sql_full(_GROUPED, 20, _MERGED, outer=False))
def search_multi(spark, sf):
    """Several queries at once, merged by file (the chunks at hand have no lines)."""
    e, asked = engine(spark, sf)
    return replace(e, spelling=False).multi(asked.withColumn("group_id", F.expr("query_id div 8")), 10).select("group_id", "query_id", "chunk_id", "rank", "score")


_FIRST = f"coalesce(list_filter({C.sql_tokens('text')}, lambda t: length(t) >= 8)[1], '')"
_DEFINED = THIN_SQL.rpartition("SELECT query_id")[0] + f""", f AS (SELECT fin.*, {R._SYMBOLS} AS names FROM fin JOIN chunks USING (chunk_id) WHERE rank <= 20), w AS (SELECT item_id AS query_id, {_FIRST} AS symbol FROM benchmark),
m AS (SELECT *, list_contains(names, symbol) AS exact, max(CAST(list_contains(names, symbol) AS INT)) OVER (PARTITION BY query_id) AS any_exact FROM f JOIN w USING (query_id))
SELECT query_id, chunk_id, rank, score, exact FROM m WHERE exact OR (any_exact = 0 AND rank <= 5)"""


@registered("find_definitions", sql_full(_PLAIN, 20, _DEFINED, outer=False, code="true"))
def find_definitions(spark, sf):
    e, asked = engine(spark, sf)
    first = F.get(symbol_names(F.col("text")), F.lit(0))
    return replace(e, spelling=False).definitions(asked.withColumn("symbol", F.coalesce(first, F.lit("")))).select("query_id", "chunk_id", "rank", "score", "exact")


@registered("find_references", sql_full(_PLAIN, 30, THIN_SQL, outer=False, code="true"))
def find_references(spark, sf):
    e, asked = engine(spark, sf)
    return replace(e, spelling=False).references(asked)


@registered("search_docs", f"""WITH {C.SQL_CHUNKS}, own AS (SELECT chunk_id FROM chunks WHERE repo_name IN ('src0', 'src1')), {C.sql_bm25(docs="documents WHERE source IN ('src0', 'src1')")}, {C.sql_ranked('scored', 10, 'sparse')}, {C.SQL_ITEM_DENSE},
near AS (SELECT dense0.* FROM dense0 SEMI JOIN own USING (chunk_id)), {C.sql_ranked('near', 10, 'dense')}, nd AS (SELECT query_id, max(rank) + 1 AS nd FROM dense GROUP BY 1), ns AS (SELECT query_id, max(rank) + 1 AS ns FROM sparse GROUP BY 1),
fused AS (SELECT query_id, chunk_id, round(1 / (60 + coalesce(d.rank, nd, 1))::DOUBLE + 1 / (60 + coalesce(s.rank, ns, 1))::DOUBLE, 9) AS score FROM dense d FULL JOIN sparse s USING (query_id, chunk_id) LEFT JOIN nd USING (query_id) LEFT JOIN ns USING (query_id)),
{C.sql_ranked('fused', 5, 'top')} SELECT query_id, chunk_id, score, CAST(rank AS INT) AS rank, 'docs' AS source FROM top""")
def search_docs(spark, sf):
    """The documentation is a collection of its own, with its own statistics; here two of the sources."""
    e, asked = engine(spark, sf)
    kind = F.when(F.col("repo_name").isin("src0", "src1"), "docs").otherwise("code")
    return replace(e, chunks=e.chunks.withColumn("collection", kind)).docs(asked)


@registered("mode_compare")
def mode_compare(spark, sf):
    """One metric table with a column for each mode."""
    e, asked = engine(spark, sf)
    cases, _, expected = R.evaluated(spark, sf)
    ch = e.chunks.select("chunk_id", "repo_name", "file_path")
    rows = None
    for mode in MODES:
        found = e.search(asked, 10, mode).join(ch, "chunk_id").withColumnRenamed("query_id", "case_id")
        one = evaluate.summary(evaluate.case_metrics(cases, found, expected)).withColumn("mode", F.lit(mode))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("metric").pivot("mode", list(MODES)).agg(F.max("score"))


@registered("result_projection", f"""WITH {C.SQL_CHUNKS}, {C.SQL_BM25}, {C.sql_ranked('scored', 10, 'top')}
SELECT query_id, CAST(rank AS INT) AS rank, chunk_id, CAST(round(CAST(score AS DECIMAL(18, 6)), 4) AS DOUBLE) AS score, 'bm25' AS source, file_path, repo_name, array_to_string({R._SYMBOLS}, ',') AS symbols, substr(content, 1, 300) AS preview FROM top JOIN chunks USING (chunk_id)""")
def result_projection(spark, sf):
    """Contents join the ten rows of each query only."""
    e, _ = engine(spark, sf)
    return components.projection(R.bm25_topk(spark, sf).join(e.chunks, "chunk_id"))


@registered("result_format", f"""WITH {C.SQL_CHUNKS}, {C.SQL_BM25}, {C.sql_ranked('scored', 3, 'top')},
l AS (SELECT query_id, rank, printf('%d. [%s] %s (%.4f)', rank, repo_name, file_path, CAST(round(CAST(score AS DECIMAL(18, 6)), 4) AS DOUBLE)) || chr(10) || substr(content, 1, 80) AS line FROM top JOIN chunks USING (chunk_id))
SELECT query_id, string_agg(line, chr(10) || '---' || chr(10) ORDER BY rank) AS text FROM l GROUP BY 1""")
def result_format(spark, sf):
    e, _ = engine(spark, sf)
    return components.formatted(R.bm25_topk(spark, sf).where("rank <= 3").join(e.chunks, "chunk_id"))


@registered("definition_fallback", f"""WITH {C.SQL_CHUNKS}, {C.SQL_BM25}, {C.sql_ranked('scored', 20, 'top')},
s AS (SELECT query_id, chunk_id, rank, {R._SYMBOLS} AS names FROM top JOIN chunks USING (chunk_id)), w AS (SELECT item_id AS query_id, coalesce(list_filter({C.sql_tokens('text')}, lambda t: length(t) >= 8)[1], '') AS symbol FROM benchmark),
m AS (SELECT *, list_contains(names, symbol) AS exact, max(CAST(list_contains(names, symbol) AS INT)) OVER (PARTITION BY query_id) AS any_exact FROM s JOIN w USING (query_id))
SELECT query_id, chunk_id, CAST(rank AS INT) AS rank, exact FROM m WHERE exact OR (any_exact = 0 AND rank <= 5)""")
def definition_fallback(spark, sf):
    e, _ = engine(spark, sf)
    top = sparse.ranked(sparse.scores(*C.tokenized(spark, sf)), 20).join(e.chunks.select("chunk_id", "symbol_names"), "chunk_id")
    first = F.get(symbol_names(F.col("text")), F.lit(0))
    asked = C.queries(spark, sf).select("query_id", F.coalesce(first, F.lit("")).alias("symbol"))
    return components.definitions(top.join(small(asked, BROADCAST_QUERIES)(asked), "query_id")).select("query_id", "chunk_id", "rank", "exact")
