"""Understanding many queries at once: flags, filters, keywords, expansion and cleaning, all as columns.

The word lists are a few dozen entries each and become literals of the plan; only the spelling check runs
Python, on the distinct tokens of the queries.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import lexicon as L
from tessera.functions import text as X


def _any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def _last(text: Column, table: dict[str, list[str]]) -> Column:
    """The last key of the table one of whose words the text holds."""
    return F.coalesce(*(F.when(_any(text, words), F.lit(key)) for key, words in reversed(list(table.items()))))


def flags(queries: DataFrame, text: str = "text") -> DataFrame:
    q = F.col(text)
    return queries.withColumns({"is_code": q.rlike(X.CODE_QUERY), "has_cjk": q.rlike(X.CJK), "is_dependency": q.rlike(X.DEPENDENCY_QUERY), "is_entry": q.rlike(X.ENTRY_QUERY)})


def filters(queries: DataFrame, text: str = "text") -> DataFrame:
    q = F.lower(F.col(text))
    return queries.withColumns({"filter_language": _last(q, L.LANGUAGE_WORDS), "filter_chunk_type": _last(q, L.TYPE_WORDS)})


def keywords(queries: DataFrame, text: str = "text") -> DataFrame:
    found = F.regexp_extract_all(F.col(text), F.lit(r"(?U)[a-zA-Z_]\w*|[一-鿿]+"), F.lit(0))
    keep = F.filter(found, lambda w: (F.char_length(w) > 1) & ~F.lower(w).isin(L.STOP_WORDS))
    return queries.withColumn("keywords", keep)


def closest(word: str, terms: list[str], cutoff: float = 0.8) -> str | None:
    """The term that a misspelt word most resembles, by the ratio of matching blocks."""
    if len(word) < 3 or word in terms:
        return None
    return next(iter(difflib.get_close_matches(word, terms, n=1, cutoff=cutoff)), None)


def corrections(queries: DataFrame, text: str = "text", terms: list[str] | None = None) -> DataFrame:
    """(query_id, token, correction) of the tokens that look misspelt."""
    terms = list(L.DOMAIN_TERMS if terms is None else terms)

    @F.pandas_udf("string")
    def fix(words: pd.Series) -> pd.Series:
        return words.map(lambda w: closest(w, terms))

    rows = queries.select("query_id", F.lower(F.col(text)).alias("_q"), F.explode(X.words(F.col(text))).alias("token"))
    known = rows.select("token").distinct().withColumn("correction", fix("token")).where("correction is not null")
    return rows.join(known, "token").where(~F.contains("_q", F.col("correction"))).select("query_id", "token", "correction")


def expand(queries: DataFrame, text: str = "text", spelling: bool = True, known: list[str] | None = None) -> DataFrame:
    """expansion (sorted distinct terms) and expanded (the query followed by them)."""
    q = F.col(text)
    low = F.lower(q)
    terms: list[Column] = []
    for zh, english in L.ZH_EN.items():
        for en in english.split():
            terms.append(F.when(F.contains(q, F.lit(zh)) & ~F.contains(low, F.lit(en)), F.lit(en)))
    for short, full in L.ABBREVIATIONS.items():
        terms.append(F.when(F.array_contains("_words", short) & ~F.contains(low, F.lit(full)), F.lit(full)))
    for en, zh in L.EN_ZH.items():
        terms.append(F.when(F.contains(low, F.lit(en)) & ~F.contains(q, F.lit(zh)), F.lit(zh)))
    out = queries.withColumn("_words", X.words(q)).withColumn("expansion", F.array_compact(F.array(*terms))).drop("_words")
    if spelling:
        fixed = corrections(queries, text, known).groupBy("query_id").agg(F.collect_set("correction").alias("_fixed"))
        out = out.join(fixed, "query_id", "left").withColumn("expansion", F.concat("expansion", F.coalesce("_fixed", F.array().cast("array<string>")))).drop("_fixed")
    out = out.withColumn("expansion", F.array_sort(F.array_distinct("expansion")))
    return out.withColumn("expanded", F.when(F.size("expansion") > 0, F.concat(q, F.lit(" "), F.array_join("expansion", " "))).otherwise(q))


def process(queries: DataFrame, text: str = "text", spelling: bool = True, known: list[str] | None = None) -> DataFrame:
    """All of the above, and the cleaned text that vectors are made of. known: the terms that spelling is held against."""
    out = expand(keywords(filters(flags(queries, text), text), text), text, spelling, known)
    return out.withColumn("cleaned", X.clean_query(F.col(text)))


def intent_hint(intent: Column) -> Column:
    """Whether an outer classification means code: true, false, or null to leave it to the flags."""
    return F.when(intent == "code", F.lit(True)).when(intent == "semantic", F.lit(False))
