"""Threshold-scaled sketches, in DataFrame functions only.

A text's sketch keeps every hash of its word shingles up to a bound: one SCALE-th of the range, or the
LEAST-th smallest hash if that lies higher. The rule is the same for every text. A text of up to LEAST
shingles is kept whole and compared exactly; between LEAST and SCALE * LEAST shingles the bound shrinks as
the text grows, to the fixed fraction. A sketch says what its bound is, and within its bound it is complete,
which is all that comparing needs: two sketches are compared on the hashes up to the lesser bound, which
estimates resemblance and, between texts of very unequal length, containment. Sketches merge by union up to
the least bound. Without the second part of the rule a text of 20 shingles would keep two or three hashes and
a shorter one often none; `tests/llm` holds the error against exact similarities on both sides of the bound.

Edge cases: a null text counts as empty. A text of fewer words than a shingle is one shingle of its own; a
text without words has an empty sketch and no fingerprint digits. Two empty sketches are alike (1), an empty
and another are not (0). Rows with equal ids follow each other in a defined order; a null id comes last.
In a table of one row the row is its own next document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORDS = 5
#: One hash in SCALE is kept.
SCALE = 8
LEAST = 64
RANGE_BYTES = 4 << 20
RANGES = 1 << 17
BELOW = -(1 << 63) + (1 << 64) // SCALE
FULL = (1 << 63) - 1


def _with(value: Column, body) -> Column:
    """body(value), where value is computed once however often body uses it."""
    return F.transform(F.array(value), body)[0]


def sketch(text: Column, words: int = WORDS) -> Column:
    """struct(kept: sorted hashes, upto: the bound within which they are all) of a text."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), "\t\n\r\f\x0b", "     ")
    tokens = F.transform(F.array_remove(F.split(plain, " "), ""), lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        return (
            F.when(F.size(h) >= words, F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - words, F.lit(0))), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(words)))))
            .when(F.size(h) > 0, F.array(F.xxhash64(h)))
            .otherwise(F.array().cast("array<bigint>"))
        )

    def chosen(s: Column) -> Column:
        low = F.sort_array(F.filter(s, lambda x: x < F.lit(BELOW)))
        kept = F.when(F.size(F.filter(s, lambda x: x < F.lit(BELOW))) >= LEAST, low).otherwise(F.slice(F.sort_array(s), 1, LEAST))
        return _with(kept, lambda k: F.struct(k.alias("kept"), F.when(F.size(k) == F.size(s), F.lit(FULL)).otherwise(F.greatest(F.lit(BELOW - 1), F.element_at(k, -1))).alias("upto")))

    return _with(tokens, lambda h: _with(F.array_distinct(shingles(h)), chosen))


def fingerprint(s: Column) -> Column:
    """The kept hashes, 16 hexadecimal digits each."""
    return F.array_join(F.transform(s["kept"], lambda x: F.lpad(F.hex(x), 16, "0")), "")


def _compared(a: Column, b: Column, body) -> Column:
    upto = F.least(a["upto"], b["upto"])
    cut = lambda s: F.filter(s["kept"], lambda x: x <= upto)
    return _with(F.struct(cut(a).alias("a"), cut(b).alias("b")), lambda p: _with(F.struct(F.size(p["a"]).alias("a"), F.size(p["b"]).alias("b"), F.size(F.array_intersect(p["a"], p["b"])).alias("both")), body))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard resemblance of two texts by their sketches, 0 to 1."""
    return _compared(a, b, lambda n: F.when(n["a"] + n["b"] == 0, F.lit(1.0)).otherwise(n["both"] / (n["a"] + n["b"] - n["both"])))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the first text's shingles that the second has; 1 for a text without any."""
    return _compared(a, b, lambda n: F.when(n["a"] == 0, F.lit(1.0)).otherwise(n["both"] / n["a"]))


def merge(sketches: Column) -> Column:
    """The sketch of the union of an array of sketches' texts."""
    upto = F.array_min(F.transform(sketches, lambda s: s["upto"]))
    kept = F.sort_array(F.array_distinct(F.flatten(F.transform(sketches, lambda s: s["kept"]))))
    return F.struct(F.filter(kept, lambda x: x <= upto).alias("kept"), upto.alias("upto"))


def with_next(rows: DataFrame, id_col: str, carry: list[str], tie: str, size: Column, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """rows with `next_<c>` for each column of carry: that of the next row by descending id, after the last of the first.

    Rows are dealt by ranges of the id of about `range_bytes` each by `size`, so no window spans the table.
    There are RANGES ranges at most, so beyond a TB they grow (0.8 GB at 100 TB); a range is sorted by one
    task, which spills. Each range's first row is dealt to the range before it in that order as well, where
    it stands last; the first of all stands in the last range.
    """
    spark = rows.sparkSession
    ident = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    total, top = rows.agg(F.sum(size), F.max(ident)).first()
    parts = max(1, min(RANGES, -(-int(total or 0) // range_bytes)))
    bounds = [] if top is None else [top]
    if parts > 1 and bounds:
        shares = F.split(F.lit(" ".join(repr(i / parts) for i in range(1, parts))), " ").cast("array<double>")
        bounds = sorted({*rows.agg(F.percentile_approx(ident, shares, max(10_000, 10 * parts))).first()[0], top})
    # a row finds its range in two steps: among each run's last bounds, and among the bounds of that run
    width = int(len(bounds) ** 0.5) + 1
    runs = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    below = lambda bs, x: F.size(F.filter(bs, lambda b: b < x))
    fine = spark.createDataFrame(list(enumerate(runs)), "_rough int, _fine array<bigint>")
    rough = F.array(*(F.lit(r[-1]).cast("long") for r in runs[:-1])).cast("array<bigint>")
    dealt = rows.withColumn("_id", ident).withColumn("_rough", below(rough, F.col("_id"))).join(F.broadcast(fine), "_rough")
    dealt = dealt.withColumn("_range", F.col("_rough") * width + below(F.col("_fine"), F.col("_id"))).withColumn("_first", F.array_contains("_fine", F.col("_id")))
    own = F.struct(F.col("_range").alias("r"), F.lit(0).alias("ghost"))
    ghost = F.struct(F.pmod(F.col("_range") + 1, F.lit(max(1, len(bounds)))).alias("r"), F.lit(1).alias("ghost"))
    dealt = dealt.withColumn("_at", F.explode(F.when(F.col("_first"), F.array(own, ghost)).otherwise(F.array(own))))
    dealt = dealt.select(*rows.columns, "_id", F.col("_at.r").alias("_r"), F.col("_at.ghost").alias("_ghost"))
    w = Window.partitionBy("_r").orderBy("_ghost", F.desc("_id"), tie)
    out = dealt.select("*", *(F.lead(c).over(w).alias(f"next_{c}") for c in carry)).where("_ghost = 0")
    return out.select(*rows.columns, *(f"next_{c}" for c in carry))


def op10(spark, sf_dir: str) -> DataFrame:
    """The contract's query."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_tie"), sketch(F.col("text")).alias("sketch"))
    rows = with_next(rows, "doc_id", ["text", "sketch"], "_tie", F.octet_length("text"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))).drop("next_text")
    rows = rows.withColumn("n_chars", n.cast("long")).drop("text")
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256)).withColumn("edited_sketch", sketch(F.col("edited")))
    own, edited, following = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(own).alias("fingerprint"), fingerprint(edited).alias("edited_fingerprint"),
        likeness(own, edited).alias("near_edited"), likeness(own, following).alias("near_next"),
        containment(edited, own).alias("edited_in_own"), containment(following, own).alias("next_in_own"),
    )
