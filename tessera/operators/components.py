"""Component and service roll-ups, point lookups, projections and their text forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def component_key() -> Column:
    return F.coalesce(F.nullif(F.col("component_name"), F.lit("")), F.col("repo_name"))


def of_component(chunks: DataFrame, repo: str, chunk_type: str | None = None) -> DataFrame:
    """A repository's chunks, or those of one kind."""
    rows = chunks.where(F.col("repo_name") == repo)
    return rows if chunk_type is None else rows.where(F.col("chunk_type") == chunk_type)


def component_stats(chunks: DataFrame) -> DataFrame:
    """Per component: distinct files, sorted languages, functions and classes among the symbols, chunks. Needs symbols."""
    kinds = lambda k: F.sum(F.size(F.filter("symbols", lambda s: s["kind"] == k)))
    return chunks.groupBy(component_key().alias("component")).agg(
        F.countDistinct("file_path").alias("files"), F.array_sort(F.collect_set("language")).alias("languages"),
        kinds("function").alias("functions"), kinds("class").alias("classes"), F.count(F.lit(1)).alias("chunks"),
    )


def component_symbols(chunks: DataFrame) -> DataFrame:
    """(component, name, kind, n): the symbols of each component as rows, as a component may have any number of them."""
    rows = chunks.select(component_key().alias("component"), F.explode("symbols").alias("s"))
    return rows.groupBy("component", F.col("s.name").alias("name"), F.col("s.kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def component_dependencies(chunks: DataFrame) -> DataFrame:
    """Per component: dependencies and interfaces of its last service chunk, and its models' and commands' names."""
    service = F.col("chunk_type") == "mds_service"
    latest = lambda c: F.max_by(F.col(c), F.when(service, F.col("ord")))
    named = lambda t: F.array_sort(F.flatten(F.collect_list(F.when(F.col("chunk_type") == t, F.transform(F.slice("symbols", 1, 1), lambda s: s["name"])))))
    return chunks.groupBy(component_key().alias("component")).agg(
        latest("dependencies").alias("dependencies"), latest("required_interfaces").alias("required_interfaces"), named("mds_model").alias("models"), named("mds_ipmi_cmd").alias("commands")
    )


def index_stats(chunks: DataFrame, by: str = "collection") -> DataFrame:
    return chunks.groupBy(by).agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("file_path").alias("files"), F.countDistinct("repo_name").alias("repos"))


def lookup(collections: list[DataFrame], ids: DataFrame) -> DataFrame:
    """The chunks of the given ids; a chunk of an earlier collection hides one of the same id in a later."""
    rows = None
    for i, c in enumerate(collections):
        own = c.join(ids, "chunk_id", "left_semi").withColumn("_c", F.lit(i))
        rows = own if rows is None else rows.unionByName(own)
    w = Window.partitionBy("chunk_id").orderBy("_c")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_c")


def definitions(results: DataFrame, symbol: str = "symbol", fallback: int = 5) -> DataFrame:
    """Results whose symbols include the one asked for; where no result of a query has it, its first `fallback` results."""
    exact = F.exists("symbol_names", lambda s: s == F.col(symbol))
    rows = results.withColumn("_m", exact.cast("int"))
    any_exact = F.max("_m").over(Window.partitionBy("query_id"))
    return rows.withColumn("_any", any_exact).where((F.col("_m") == 1) | ((F.col("_any") == 0) & (F.col("rank") <= fallback))).withColumn("exact", F.col("_m") == 1).drop("_m", "_any")


def projection(results: DataFrame, preview: int = 300) -> DataFrame:
    """The flat form of results: place, score to four digits, source, symbols joined, a preview of the content."""
    return results.select(
        "query_id", "rank", "chunk_id", F.round("score", 4).alias("score"), "source", "file_path", "repo_name",
        F.array_join("symbol_names", ",").alias("symbols"), F.substring("content", 1, preview).alias("preview"),
    )


def formatted(results: DataFrame, preview: int = 80) -> DataFrame:
    """One text a query: numbered results parted by lines of dashes."""
    line = F.format_string("%d. [%s] %s (%.4f)\n%s", "rank", "repo_name", "file_path", F.round("score", 4), F.substring("content", 1, preview))
    rows = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))
    return rows.select("query_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n---\n").alias("text"))
