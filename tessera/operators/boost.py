"""Additive boosts for chunks whose symbols, repository, path or model a query names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import DEPENDENCY_QUERY, stem, words
from tessera.operators.fusion import rerank

# The sizes of the boosts.
SYMBOL, SYMBOL_EXACT = 0.008, 0.025
REPO, PATH, FILE_NAME = 0.006, 0.006, 0.020
MODEL_CLASS, SERVICE = 0.012, 0.010
PARTIAL = 0.8
LONG_NAME = 8


def symbol_bonus(query: Column, tokens: Column, names: Column) -> Column:
    """For the first symbol that the query names or a token of three letters is part of; more if the query is that symbol."""
    q = F.lower(query)
    long = F.filter(tokens, lambda t: F.char_length(t) >= 3)
    named = F.filter(F.transform(names, F.lower), lambda s: F.contains(q, s) | F.exists(long, lambda t: F.contains(s, t)))
    first = F.get(named, F.lit(0))
    return F.when(first.isNull(), 0.0).when(F.trim(q) == first, SYMBOL_EXACT).otherwise(SYMBOL)


def repo_bonus(query: Column, tokens: Column, repo: Column) -> Column:
    r = F.lower(repo)
    near = F.exists(tokens, lambda t: (F.char_length(t) >= 3) & F.contains(r, t))
    return F.when(F.contains(F.lower(query), r), REPO).when(near, REPO * PARTIAL).otherwise(0.0)


def path_bonus(query: Column, tokens: Column, path: Column) -> Column:
    """The whole path, else the file's name if it is telling (compound or long), else distinct parts of the path."""
    q, p = F.lower(query), F.lower(path)
    name = stem(p)
    parts = F.array_distinct(F.filter(F.split(p, "[/_.-]"), lambda x: x != ""))
    hits = F.size(F.filter(parts, lambda x: F.array_contains(tokens, x) | F.contains(q, x)))
    telling = F.array_contains(tokens, name) & (F.contains(name, F.lit("_")) | (F.char_length(name) >= LONG_NAME))
    return F.when(F.contains(q, p), PATH).when(telling, FILE_NAME).when(hits >= 2, PATH).when(hits == 1, PATH * PARTIAL).otherwise(0.0)


def model_bonus(query: Column, model: Column) -> Column:
    return F.when((F.coalesce(model, F.lit("")) != "") & F.contains(F.lower(query), F.lower(model)), MODEL_CLASS).otherwise(0.0)


def service_bonus(query: Column, chunk_type: Column) -> Column:
    return F.when((chunk_type == "mds_service") & F.lower(query).rlike(DEPENDENCY_QUERY), SERVICE).otherwise(0.0)


def boost(ranked: DataFrame, query: str = "query") -> DataFrame:
    """Adds all boosts to a list that has the columns query, symbol_names, repo_name, file_path, mds_class and chunk_type, and ranks anew."""
    q = F.col(query)
    rows = ranked.withColumn("_t", words(q))
    t = F.col("_t")
    parts = {
        "symbol_bonus": symbol_bonus(q, t, F.col("symbol_names")),
        "repo_bonus": repo_bonus(q, t, F.col("repo_name")),
        "path_bonus": path_bonus(q, t, F.col("file_path")),
        "model_bonus": model_bonus(q, F.col("mds_class")),
        "service_bonus": service_bonus(q, F.col("chunk_type")),
    }
    rows = rows.withColumns({k: v.cast("double") for k, v in parts.items()}).drop("_t")
    total = F.col("score")
    for k in parts:
        total = total + F.col(k)
    rows = rows.withColumn("score", F.round(total, 9)).withColumnRenamed("rank", "_before")
    return rerank(rows, then=("_before",)).drop("_before")
