"""Connected components of a link table, by alternating large and small stars, and joins on keys that one value may dominate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


#: Tables of up to so many rows are joined as they are; in larger ones a key of more than one in HOT_SHARE rows is hot.
HOT_ROWS, HOT_SHARE = 20_000, 1_000


def join_hot(left: DataFrame, right: DataFrame, key: str, rows: int | None = None) -> DataFrame:
    """left.join(right, key), where right has one row a key and any number of left's rows may share one.

    Hot keys are at most HOT_SHARE, so what right has of them is broadcast and their rows stay where they are;
    only the others are dealt by key.
    """
    n = left.count() if rows is None else rows
    if n <= HOT_ROWS:
        return left.join(right, key)
    hot = stored(left.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > n / HOT_SHARE).select(key), "hot-keys")
    if not hot.limit(1).count():
        return left.join(right, key)
    few = F.broadcast(right.join(F.broadcast(hot), key, "left_semi"))
    return left.join(F.broadcast(hot), key, "left_anti").join(right, key).unionByName(left.join(few, key))


def _star(edges: DataFrame, large: bool, rows: int) -> DataFrame:
    """One round. Large: larger neighbours go to the smallest of the neighbourhood. Small: the node and its smaller neighbours do."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = join_hot(both, least, "a", 2 * rows).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        out = join_hot(down, least, "a", rows).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
    return out.where("a <> b").distinct()


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(a, b): each linked node but the smallest of its component, and that smallest node.

    edges has two columns a and b of one comparable type. Each round is written to the shared folder and
    read again, so no lineage grows and no executor holds the only copy. Hubs are met by partial minima, and
    their rows stay where they are in the joins.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    for _ in range(most_rounds):
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == state or not now[0]:
            return edges
        state = tuple(now)
        edges = stored(_star(_star(edges, True, now[0]), False, now[0]), "links")
    raise RuntimeError(f"the components did not settle in {most_rounds} rounds")
