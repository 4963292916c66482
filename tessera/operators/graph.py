"""A typed property graph as two tables, and walks over it.

nodes (node_id, node_type, name, chunk_id), edges (src, dst, edge_type, weight). Walks are a fixed small
number of joins; each step is cut by the score that is left before the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import GraphConfig
from tessera.functions.text import name_before, words

# Kinds of symbols that are entities, the patterns of imports and calls, words that are no calls, and the weights.
ENTITY_KINDS = ("function", "class", "method", "ipmi_command")
LUA_REQUIRE = r"""require\s*\(?\s*["']([^"']+)["']\s*\)?"""
C_INCLUDE = r'#include\s*"([^"]+)"'
LUA_CALL = r"(?:\w+\s*:\s*)?(\w+)\s*\("
C_CALL = r"(\w+)\s*\("
NO_CALLS = [
    "if", "else", "while", "for", "switch", "case", "return", "sizeof", "typeof", "typedef", "struct", "enum", "union", "class", "do", "break",
    "continue", "goto", "default", "NULL",
]
WALKED = ("CALLS", "DEPENDS_ON", "IMPORTS", "REQUIRES_IFACE", "PROVIDES_IFACE")


def nodes(chunks: DataFrame) -> DataFrame:
    """Components, files, entities and interfaces; of several chunks that make one node the first (by id) counts."""
    base = F.col("repo_name"), F.col("file_path")
    part = lambda df, i, t, n, c: df.select(i.alias("node_id"), F.lit(t).alias("node_type"), n.alias("name"), c.alias("chunk_id"), F.col("chunk_id").alias("_o"))
    none = F.lit(None).cast(chunks.schema["chunk_id"].dataType)
    entity = chunks.select("*", F.explode("symbols").alias("s")).where(F.col("s.kind").isin(*ENTITY_KINDS))
    iface = chunks.where("chunk_type = 'mds_service'").select("*", F.explode("required_interfaces").alias("i"))
    every = part(chunks, base[0], "component", base[0], none).unionByName(part(chunks, F.concat_ws(":", *base), "file", base[1], none))
    every = every.unionByName(part(entity, F.concat_ws(":", *base, "s.name"), "entity", F.col("s.name"), F.col("chunk_id"))).unionByName(part(iface, F.concat(F.lit("iface:"), "i"), "interface", F.col("i"), none))
    return every.groupBy("node_id").agg(*(F.min_by(c, "_o").alias(c) for c in ("node_type", "name", "chunk_id")))


def structure(chunks: DataFrame) -> DataFrame:
    """BELONGS_TO, CONTAINS, DEFINES, REQUIRES_IFACE and DEPENDS_ON edges."""
    f = F.concat_ws(":", "repo_name", "file_path")
    edge = lambda df, a, b, t: df.select(a.alias("src"), b.alias("dst"), F.lit(t).alias("edge_type"))
    entity = chunks.select("repo_name", "file_path", F.explode("symbols").alias("s")).where(F.col("s.kind").isin(*ENTITY_KINDS))
    e = F.concat_ws(":", "repo_name", "file_path", "s.name")
    service = chunks.where("chunk_type = 'mds_service'")
    deps = service.select("repo_name", F.explode("dependencies").alias("d")).withColumn("d", name_before(F.col("d"))).where("d <> ''")
    iface = service.select("repo_name", F.explode("required_interfaces").alias("i"))
    out = edge(chunks, f, F.col("repo_name"), "BELONGS_TO").unionByName(edge(entity, f, e, "CONTAINS")).unionByName(edge(entity, F.col("repo_name"), e, "DEFINES"))
    return out.unionByName(edge(iface, F.col("repo_name"), F.concat(F.lit("iface:"), "i"), "REQUIRES_IFACE")).unionByName(edge(deps, F.col("repo_name"), F.col("d"), "DEPENDS_ON")).distinct()


def imports(chunks: DataFrame, modules: DataFrame) -> DataFrame:
    """IMPORTS edges. modules: (module, component). Lua falls back to the text before the first dot, C to nothing."""
    lua = chunks.where("language = 'lua'").select("repo_name", "language", F.explode(F.regexp_extract_all("content", F.lit(LUA_REQUIRE), F.lit(1))).alias("module"))
    c = chunks.where("language in ('c', 'cpp')").select("repo_name", "language", F.explode(F.regexp_extract_all("content", F.lit(C_INCLUDE), F.lit(1))).alias("module"))
    rows = lua.unionByName(c).join(modules, "module", "left")
    target = F.coalesce("component", F.when(F.col("language") == "lua", F.substring_index("module", ".", 1)))
    return rows.select(F.col("repo_name").alias("src"), target.alias("dst"), F.lit("IMPORTS").alias("edge_type")).where("dst is not null").distinct()


def calls(chunks: DataFrame) -> DataFrame:
    """CALLS edges from each entity of a chunk to every entity of another id that the chunk calls by name."""
    entity = chunks.select("chunk_id", "repo_name", "file_path", F.explode("symbols").alias("s")).where(F.col("s.kind").isin(*ENTITY_KINDS))
    entity = entity.select("chunk_id", F.concat_ws(":", "repo_name", "file_path", "s.name").alias("id"), F.col("s.name").alias("callee"))
    found = lambda p: F.array_distinct(F.regexp_extract_all("content", F.lit(p), F.lit(1)))
    lua = chunks.where("language = 'lua'").select("chunk_id", F.explode(found(LUA_CALL)).alias("callee"))
    c = chunks.where("language in ('c', 'cpp')").select("chunk_id", F.explode(found(C_CALL)).alias("callee")).where(~F.col("callee").isin(NO_CALLS))
    sites = lua.unionByName(c).join(entity.select("chunk_id", F.col("id").alias("src")), "chunk_id")
    targets = entity.select("callee", F.col("id").alias("dst")).distinct()
    return sites.join(targets, "callee").where("src <> dst").select("src", "dst", F.lit("CALLS").alias("edge_type")).distinct()


def sound(edges: DataFrame, nodes: DataFrame, single: bool = False, order: str | None = None) -> DataFrame:
    """Edges both of whose ends exist; with `single` one edge a pair, the last by `order`."""
    ids = nodes.select("node_id").distinct()
    out = edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    if not single:
        return out
    rest = [c for c in out.columns if c not in ("src", "dst")]
    return out.groupBy("src", "dst").agg(*(F.max_by(c, F.col(order)).alias(c) for c in rest))


def both_ways(edges: DataFrame, types: tuple[str, ...] | None = None) -> DataFrame:
    own = edges if types is None else edges.where(F.col("edge_type").isin(*types))
    return own.select("src", "dst").unionByName(own.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def neighbors(edges: DataFrame, of: DataFrame, direction: str = "both", types: tuple[str, ...] | None = None) -> DataFrame:
    """(node_id, neighbor) of the nodes in `of`."""
    own = edges if types is None else edges.where(F.col("edge_type").isin(*types))
    out = own.select(F.col("src").alias("node_id"), F.col("dst").alias("neighbor"))
    back = own.select(F.col("dst").alias("node_id"), F.col("src").alias("neighbor"))
    rows = {"out": out, "in": back, "both": out.unionByName(back)}[direction]
    return rows.join(of.select("node_id"), "node_id", "left_semi").distinct()


def bfs(edges: DataFrame, seeds: DataFrame, hops: int = 2, types: tuple[str, ...] | None = None) -> DataFrame:
    """(seed, node_id, score): 1 for the seed, 1 / (hops + 1) for what is that many steps away; the best counts."""
    step = both_ways(edges, types).withColumnRenamed("src", "node_id")
    seen = seeds.select(F.col("node_id").alias("seed"), "node_id", F.lit(0).alias("h"))
    for h in range(1, hops + 1):
        more = seen.where(F.col("h") == h - 1).join(step, "node_id").select("seed", F.col("dst").alias("node_id"), F.lit(h).alias("h"))
        seen = seen.unionByName(more).groupBy("seed", "node_id").agg(F.min("h").alias("h"))
    return seen.select("seed", "node_id", F.round(1 / (F.col("h") + 1), 6).alias("score"))


def decay_expand(edges: DataFrame, seeds: DataFrame, config: GraphConfig = GraphConfig(), types: tuple[str, ...] | None = WALKED) -> DataFrame:
    """(query_id, node_id, score): seeds' scores halve with every step, what falls below the limit is not followed, the best counts."""
    step = both_ways(edges, types).withColumnRenamed("src", "node_id")
    seen = seeds.groupBy("query_id", "node_id").agg(F.max("score").alias("score"))
    for _ in range(config.max_hops):
        more = seen.withColumn("score", F.col("score") * config.decay).where(F.col("score") >= config.prune).join(step, "node_id").select("query_id", F.col("dst").alias("node_id"), "score")
        seen = seen.unionByName(more).groupBy("query_id", "node_id").agg(F.max("score").alias("score"))
    return seen.withColumn("score", F.round("score", 6))


def seeds(results: DataFrame, queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, node_id, score) from the first ten results, component names (0.9) and entity names (0.3) in the query.

    results: query_id, rank, repo_name, file_path, symbol_names.
    """
    top = results.where("rank <= 10")
    comp = top.select("query_id", F.col("repo_name").alias("node_id"), (F.lit(0.8) / F.col("rank")).alias("score"))
    ent = top.select("query_id", "rank", "repo_name", "file_path", F.explode(F.slice("symbol_names", 1, 3)).alias("s")).select("query_id", F.concat_ws(":", "repo_name", "file_path", "s").alias("node_id"), (F.lit(0.5) / F.col("rank")).alias("score"))
    token = queries.select("query_id", F.posexplode(words(F.col("text"))).alias("pos", "t"))
    named = token.where(F.char_length("t") >= 3).select("query_id", F.col("t").alias("node_id"), F.lit(0.9).alias("score"))
    entity = nodes.where("node_type = 'entity'").select(F.col("name").alias("t"), "node_id")
    two = F.row_number().over(Window.partitionBy("query_id", "t").orderBy("node_id"))
    ten = F.row_number().over(Window.partitionBy("query_id").orderBy("pos", "node_id"))
    by_name = token.where(F.char_length("t") >= 4).join(entity, "t").withColumn("_a", two).where("_a <= 2").withColumn("_b", ten).where("_b <= 10").select("query_id", "node_id", F.lit(0.3).alias("score"))
    every = comp.unionByName(ent).unionByName(named).join(nodes.select("node_id"), "node_id", "left_semi").select("query_id", "node_id", "score").unionByName(by_name)
    return every.groupBy("query_id", "node_id").agg(F.round(F.max("score"), 6).alias("score"))


def cross_calls(edges: DataFrame, nodes: DataFrame, seen: DataFrame) -> DataFrame:
    """(query_id, node_id, score) of entities in other components that the seen entities, or others of their files, call.

    Callers of the same file weigh 0.3, a call 0.6, entities of the called one's file 0.4, entities of the
    called component's main file 0.3 of the component's best call.
    """
    info = nodes.where("node_type = 'entity'").select("node_id", F.substring_index("node_id", ":", 1).alias("comp"), F.substring_index("node_id", ":", 2).alias("file"), "chunk_id")
    inside = edges.where("edge_type = 'CONTAINS'").select(F.col("src").alias("file"), F.col("dst").alias("sib"))
    call = edges.where("edge_type = 'CALLS'").select(F.col("src").alias("node_id"), F.col("dst").alias("callee"))
    own = seen.join(info, "node_id")
    sib = own.join(inside, "file").select("query_id", F.col("sib").alias("node_id"), (F.col("score") * 0.3).alias("score")).join(seen.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti")
    sources = own.select("query_id", "node_id", "score").unionByName(sib).groupBy("query_id", "node_id").agg(F.max("score").alias("score"))
    target = info.where("chunk_id is not null").select(F.col("node_id").alias("callee"), F.col("comp").alias("to_comp"), F.col("file").alias("to_file"))
    hit = sources.join(call, "node_id").join(target, "callee").where(F.col("to_comp") != F.substring_index("node_id", ":", 1))
    hit = hit.groupBy("query_id", F.col("callee").alias("node_id"), "to_comp", "to_file").agg((F.max("score") * 0.6).alias("score")).join(seen.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti")
    near = hit.join(inside.withColumnRenamed("file", "to_file"), "to_file").select("query_id", F.col("sib").alias("node_id"), (F.col("score") * 0.4).alias("score"))
    nth = F.row_number().over(Window.partitionBy("file").orderBy("sib"))
    main = inside.where(F.endswith("file", F.lit("_app.lua"))).withColumn("_n", nth).where("_n <= 5").withColumn("to_comp", F.substring_index("file", ":", 1))
    app = hit.groupBy("query_id", "to_comp").agg(F.max("score").alias("score")).join(main, "to_comp").select("query_id", F.col("sib").alias("node_id"), (F.col("score") * 0.3).alias("score"))
    known = seen.select("query_id", "node_id").unionByName(hit.select("query_id", "node_id"))
    more = near.unionByName(app).join(known, ["query_id", "node_id"], "left_anti").groupBy("query_id", "node_id").agg(F.max("score").alias("score"))
    return hit.select("query_id", "node_id", "score").unionByName(more).withColumn("score", F.round("score", 6))


def peers(edges: DataFrame, seen: DataFrame, score: float = 0.3) -> DataFrame:
    """seen and, at a low score, every node that requires an interface which a seen node requires too."""
    need = edges.where("edge_type = 'REQUIRES_IFACE'").select(F.col("src").alias("node_id"), F.col("dst").alias("iface"))
    other = seen.join(need, "node_id").select("query_id", "iface").distinct().join(need, "iface").select("query_id", "node_id").distinct()
    new = other.join(seen.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti").withColumn("score", F.lit(score))
    return seen.select("query_id", "node_id", "score").unionByName(new)


def to_results(seen: DataFrame, nodes: DataFrame, original: DataFrame, k: int = 30) -> DataFrame:
    """The best k chunks of the seen entities that the original results lack."""
    rows = seen.join(nodes.where("chunk_id is not null").select("node_id", "chunk_id"), "node_id").groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    rows = rows.join(original.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("source", F.lit("graph"))


def type_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.groupBy(F.col("node_type").alias("type")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("node"))
    return n.unionByName(edges.groupBy(F.col("edge_type").alias("type")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("edge")))
