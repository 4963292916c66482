"""Toxicity by class-conditional Kneser-Ney models.

Two models of words as byte sequences, one of the toxic and one of the ordinary labelled texts. A byte is
predicted from the ORDER - 1 bytes before it, but not beyond the gap before its word, by absolute discounting;
what a class has rarely seen it takes from one distribution that both share: Kneser-Ney continuation counts
(after how many longer contexts a byte follows the last SHORT bytes) over all counted texts. Bytes rather than
whole words, so that inflected and compounded expressions share their stem's evidence.

A toxic text is ordinary in most of its words, so its likelihood is that of a mixture in which a share TOXIC
of the words comes from the toxic model and the others from the ordinary one. A text's score is a logistic
function of its length-normalised log-likelihood ratio, normalised by its words and by their square root:
chance sums grow with a text like the latter, evidence like the former.

All labelled texts of folds 1 to 3 are counted, by partial sums and shuffles; fold 4 only calibrates, and
fold 0 is held out. An n-gram has an entry if it occurs LEAST times or more, whatever the corpus's size, so
the model grows with the corpus; the mass of rarer ones is in the backoff weights, and there the shared
distribution cancels out of the ratio. A model of up to BROADCAST entries is broadcast. Beyond that it stays a
table: each part of the documents writes the distinct n-grams it asks for, they are joined with the table by a
shuffle, and each part reads its answers back. Both ways give the same scores.

Edge cases: null and empty texts and texts without words have ratio 0 and so the calibrated score of no
evidence. Without labels of both classes the score is the share of toxic labels, or 0 with none at all.
Repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as B
from .labelled import logistic, sample_with_label, with_label
from .shared import scratch, stored
from .wordmemory import Numbers, names, ragged

ORDER = 8  # bytes of the longest n-gram: they fill a 64-bit number
SHORT = 3
LEAST = 3
TOXIC = 0.01
GAP = 32
#: Share of the shared distribution that goes to all bytes alike, and its discount.
FLOOR = 0.75
BROADCAST = 6_000_000
#: Words whose ratios a worker remembers; results don't depend on it.
REMEMBERED = 1 << 19
#: Masks of a number's last 1 to ORDER bytes.
FIRST = np.array([(1 << 8 * (n + 1)) - 1 for n in range(ORDER)], np.uint64)


@dataclass
class Grams:
    """The n-grams of the words of some texts, in order."""

    gram: np.ndarray  # the bytes of context and predicted byte as a number
    word: np.ndarray  # first n-gram of each word (words + 1)
    first: np.ndarray  # first word of each row (rows + 1)


def grams_of(data: np.ndarray, offsets: np.ndarray) -> Grams:
    """An n-gram for each byte of each word and for the gap that ends it. Gaps are the byte GAP."""
    low = B.LOWER[data]
    starts, ends, first = B.words(low, offsets, B.LETTER_BYTES)
    return Grams(*word_grams(low, starts, ends), first)


def word_grams(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of some words, and each word's first (words + 1)."""
    size = ends - starts
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    # all words, each after a gap, and a gap at the end
    gap = np.cumsum(size + 1) - (size + 1)
    flat = np.full(int(gap[-1] + size[-1]) + 2, GAP, np.uint8)
    body = np.ones(len(flat), bool)
    body[gap], body[-1] = False, False
    flat[body] = ragged(low, starts, size)
    # the last ORDER bytes up to each place, as a number
    last = flat.astype(np.uint64)
    for by in (1, 2, 4):
        last[by:] |= last[:-by] << np.uint64(8 * by)
    # the n-grams of word j end at its bytes and the gap after it, from gap[j] + 1 to gap[j + 1]
    deep = np.arange(1, len(flat), dtype=np.int32)
    deep -= np.repeat(gap.astype(np.int32), size + 1)
    np.minimum(deep, ORDER - 1, out=deep)
    gram = last[1:]
    gram &= FIRST[deep]
    return gram, np.append(gap, len(gram))


def count(rows: DataFrame, text_col: str, label_col: str) -> DataFrame:
    """(gram, c0, c1): ordinary and toxic occurrences of each n-gram of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = B.column_bytes(batch.column(batch.schema.get_field_index(text_col)))
            toxic = batch.column(batch.schema.get_field_index(label_col)).to_numpy(zero_copy_only=False) > 0
            for a, b in B.slices(offsets, rows=8 * B.SLICE_ROWS):
                for part in B.pieces(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], B.LETTER_BYTES):
                    g = grams_of(*part)
                    bad = np.repeat(toxic[a:b], np.diff(g.word[g.first]))
                    for kind in (False, True):
                        gram, n = np.unique(g.gram[bad == kind], return_counts=True)
                        none = np.zeros(len(n), np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(none if kind else n), pa.array(n if kind else none)], names=["gram", "c0", "c1"])

    found = rows.select(text_col, label_col).mapInArrow(run, "gram long, c0 long, c1 long")
    return found.groupBy("gram").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))


def context(gram) -> F.Column:
    return F.shiftrightunsigned(gram, 8)


def entries(counts: DataFrame) -> DataFrame | None:
    """(key, context, llr): log-likelihood ratios (toxic over ordinary) of the n-grams that have an entry, and of an unseen byte after their contexts.

    None without counts of both classes.
    """
    table = stored(counts, "toxicity-counts")
    s = lambda cond: F.count_if(F.expr(cond))
    n0, n1, *ones = (float(x or 0) for x in table.agg(F.sum("c0"), F.sum("c1"), s("c0 = 1"), s("c0 = 2"), s("c1 = 1"), s("c1 = 2")).first())
    if not n0 or not n1:
        return None
    d = [_discount(*ones[:2]), _discount(*ones[2:])]
    has = F.col("c0") + F.col("c1") >= LEAST
    # Kneser-Ney continuation counts: the distinct contexts before a short n-gram, and before any byte in its place
    short = F.col("gram").bitwiseAND(F.lit((1 << 8 * (SHORT + 1)) - 1))
    types = table.groupBy(short.alias("short")).agg(F.count(F.lit(1)).alias("types"))
    own = Window.partitionBy(context("short"))
    kinds = F.count(F.lit(1)).over(own)
    whole = F.sum("types").over(own)
    shared = types.select("short", (F.greatest(F.col("types") - FLOOR, F.lit(0.0)) / whole + FLOOR * kinds / whole / 256).alias("base"))
    ctx = Window.partitionBy("ctx")
    seen = table.select("gram", "c0", "c1", short.alias("short"), context("gram").alias("ctx"), has.alias("has"))
    for c in (0, 1):
        kept = F.when(F.col("has"), F.greatest(F.col(f"c{c}") - d[c], F.lit(0.0))).otherwise(0.0)
        seen = seen.withColumn(f"s{c}", F.sum(f"c{c}").over(ctx)).withColumn(f"k{c}", kept)
        # what a class has seen of a context but not kept as entries; all of it where it has seen nothing
        left = F.when(F.col(f"s{c}") > 0, F.greatest(1 - F.sum(f"k{c}").over(ctx) / F.col(f"s{c}"), F.lit(1e-3))).otherwise(1.0)
        seen = seen.withColumn(f"left{c}", left)
    seen = seen.where("has").join(shared, "short")
    p = [F.when(F.col(f"s{c}") > 0, F.col(f"k{c}") / F.col(f"s{c}")).otherwise(0.0) + F.col(f"left{c}") * F.col("base") for c in (0, 1)]
    ratio = lambda a, b: F.log(F.greatest(a, F.lit(1e-12))) - F.log(F.greatest(b, F.lit(1e-12)))
    grams = seen.select(F.col("gram").alias("key"), F.lit(False).alias("context"), ratio(p[1], p[0]).cast("float").alias("llr"), "ctx", "left0", "left1")
    grams = stored(grams, "toxicity-grams")
    backoff = grams.groupBy("ctx").agg(F.first("left0").alias("left0"), F.first("left1").alias("left1"))
    backoff = backoff.select(F.col("ctx").alias("key"), F.lit(True).alias("context"), ratio(F.col("left1"), F.col("left0")).cast("float").alias("llr"))
    return grams.select("key", "context", "llr").unionByName(backoff)


def _discount(ones: float, twos: float) -> float:
    return ones / (ones + 2 * twos) if ones else 0.5


# ---------------------------------------------------------------- looking ratios up
#: A context and an n-gram of the same bytes are two keys.
TURN = np.uint64(0x9E3779B97F4A7C15)


def keys_of(key: np.ndarray, is_context: np.ndarray | bool) -> np.ndarray:
    """Numbers that tell n-grams and contexts apart and spread evenly."""
    return np.where(is_context, B.mix(key ^ TURN), B.mix(key))


@dataclass
class Table:
    """Ratios by key; those of a part's answers are not a number where the model has no entry, and `whole`: what they lack wasn't asked for."""

    key: np.ndarray
    llr: np.ndarray
    whole: bool = False


class Ratios:
    """Looks ratios up in a table, and remembers those of whole words."""

    def __init__(self, table: Table):
        self.whole, self.numbers = table.whole, Numbers(len(table.key))
        self.numbers.add(table.key)
        self.llr = np.append(table.llr, np.float32(np.nan))  # none for number -1
        self.forget()

    def forget(self) -> None:
        self.words, self.of_word = Numbers(REMEMBERED), np.zeros(REMEMBERED)

    def of_grams(self, gram: np.ndarray) -> np.ndarray:
        """The ratio of each n-gram: its own, or its context's, or none."""
        at = self.numbers.find(keys_of(gram, False))
        if self.whole and (at < 0).any():
            raise RuntimeError("these texts are not those of the part that asked: the documents' plan is not repeatable")
        out = self.llr[at]
        rest = np.flatnonzero(np.isnan(out))
        out[rest] = self.llr[self.numbers.find(keys_of(gram[rest] >> np.uint64(8), True))]
        return np.nan_to_num(out, copy=False)

    def of_words(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The summed ratio of each word."""
        out = np.zeros(len(starts))
        for a in range(0, len(starts), REMEMBERED // 2):
            s, e = starts[a : a + REMEMBERED // 2], ends[a : a + REMEMBERED // 2]
            h = names(low, s, e)
            at = self.words.find(h)
            miss = np.flatnonzero(at < 0)
            if len(miss):
                fresh, where = np.unique(h[miss], return_index=True)
                if self.words.n + len(fresh) > REMEMBERED:
                    self.forget()
                    miss = np.arange(len(h))
                    fresh, where = np.unique(h, return_index=True)
                gram, word = word_grams(low, s[miss[where]], e[miss[where]])
                total = np.concatenate(([0.0], np.cumsum(self.of_grams(gram), dtype=np.float64)))
                self.of_word[self.words.add(fresh)] = np.diff(total[word])
                at[miss] = self.words.find(h[miss])
            out[a : a + len(s)] = self.of_word[at]
        return out


_built: list[tuple[Table, Ratios]] = []


def ratios(table: Table) -> Ratios:
    """A table's look-up, built once a worker; that of the last table is kept."""
    if not _built or _built[0][0] is not table:
        _built[:] = [(table, Ratios(table))]
    return _built[0][1]


def evidence(data: np.ndarray, offsets: np.ndarray, table: Table | None) -> tuple[np.ndarray, np.ndarray]:
    """Each row's log-likelihood ratio, and its words."""
    total, n = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1, np.int64)
    for part, bounds in B.pieces(data, offsets, B.LETTER_BYTES):
        low = B.LOWER[part]
        starts, ends, first = B.words(low, bounds, B.LETTER_BYTES)
        word = ratios(table).of_words(low, starts, ends) if table is not None else np.zeros(len(starts))
        word = np.log(1 - TOXIC + TOXIC * np.exp(np.minimum(word, 50.0)))
        total += np.diff(np.concatenate(([0.0], np.cumsum(word)))[first])
        n += np.diff(first)
    return total, n


def normalised(total: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ratios for each word, and for each square root of the words."""
    n = np.maximum(n, 1)
    return total / n, total / np.sqrt(n)


@dataclass
class Model:
    """Entries as a table and, if there are few enough, at hand; and the calibration."""

    entries: DataFrame | None = None
    table: object = None  # a broadcast Table
    weights: np.ndarray = field(default_factory=lambda: np.zeros(3))

    def score(self, mean: np.ndarray, root: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.column_stack((mean, root)) @ self.weights[:-1] + self.weights[-1], -30, 30)))


def fit(counts: DataFrame, most: int | None = None) -> Model:
    """The model of all counts, without calibration; broadcast if it has up to `most` entries."""
    got = entries(counts)
    if got is None:
        return Model()
    spark = counts.sparkSession
    got = stored(got, "toxicity-model")
    if got.count() > (BROADCAST if most is None else most):
        return Model(got)
    t = got.toArrow()
    key, kind, llr = (t.column(i).to_numpy() for i in range(3))
    return Model(got, spark.sparkContext.broadcast(Table(keys_of(key.view(np.uint64), kind), llr)))


def _asked(docs: DataFrame, text_col: str) -> DataFrame:
    """(part, key, context): the distinct n-grams of each part of docs, and their contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId(), [], 0
        for batch in batches:
            data, offsets = B.column_bytes(batch.column(0))
            for part in (p for a, b in B.slices(offsets) for p in B.pieces(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], B.LETTER_BYTES)):
                held.append(np.unique(grams_of(*part).gram))
                size += len(held[-1])
                if size > 1 << 22:
                    held = [np.unique(np.concatenate(held))]
                    size = len(held[0])
        gram = np.unique(np.concatenate(held)) if held else np.zeros(0, np.uint64)
        for kind, key in ((False, gram), (True, np.unique(gram >> np.uint64(8)))):
            for at in range(0, len(key), 1 << 16):
                own = key[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), number, np.int64)), pa.array(own.view(np.int64)), pa.array(np.full(len(own), kind))], names=["part", "key", "context"])

    return docs.select(text_col).mapInArrow(run, "part long, key long, context boolean")


def answered(docs: DataFrame, model: Model, text_col: str) -> str:
    """Joins what each part of docs asks for with the model's table; gives the folder of the answers by part.

    An n-gram that the table lacks is answered as well, with null, so that a part can tell that the folder is its own.
    """
    where = scratch(docs.sparkSession, "toxicity-answers")
    got = _asked(docs, text_col).join(model.entries, ["key", "context"], "left")
    got.repartition("part").write.partitionBy("part").parquet(where)
    return where


def _answers(where: str, part: int) -> Table:
    fs, path = pafs.FileSystem.from_uri(where)
    if fs.get_file_info(f"{path}/part={part}").type == pafs.FileType.NotFound:
        return Table(np.zeros(0, np.uint64), np.zeros(0, np.float32), True)
    t = pq.read_table(f"{path}/part={part}", filesystem=fs, columns=["key", "context", "llr"], partitioning=None)
    llr = t.column("llr").to_numpy()  # not a number where there is no entry
    return Table(keys_of(t.column("key").to_numpy().view(np.uint64), t.column("context").to_numpy()), llr.astype(np.float32), True)


def annotate_ratios(df: DataFrame, model: Model, text_col: str, keep: list[str] | None, fields: list[str], last) -> DataFrame:
    """df with last(mean, root) of every whole text as double columns."""
    shared, where = model.table, None
    if model.entries is not None and shared is None:
        df = df.select(*dict.fromkeys([*(df.columns if keep is None else keep), text_col]))
        where = answered(df, model, text_col)

    def scorer():
        if shared is not None:
            table = shared.value
        elif where is not None:
            table = _answers(where, TaskContext.get().partitionId())
        else:
            table = None

        return lambda data, offsets, col: last(*normalised(*evidence(data, offsets, table)))

    return B.annotate(df, text_col, [T.StructField(c, T.DoubleType()) for c in fields], scorer, keep)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_label: int = 3000, most: int | None = None) -> Model:
    """Counts three quarters of the labelled rows; calibrates on a bounded sample of the last quarter, about `per_label` rows a class."""
    rows = with_label(docs.select(id_col, text_col), labels.select(id_col, "toxic"), "toxic", id_col)
    part = B.fold(id_col, 5)
    model = fit(count(rows.where(part.isin(1, 2, 3)), text_col, "_label"), most)
    held = stored(sample_with_label(docs.select(id_col, text_col), labels, "toxic", per_label, 5, (4,), id_col).select("_label", text_col), "toxicity-held")
    got = annotate_ratios(held, model, text_col, ["_label"], ["_mean", "_root"], lambda mean, root: [mean, root]).collect()
    x = np.array([(r["_mean"], r["_root"]) for r in got], float).reshape(-1, 2)
    y = np.array([float(r["_label"] > 0) for r in got])
    if len(set(y)) == 2:
        model.weights = logistic(x, y, ridge=1e-3)
    else:
        share = y.mean() if len(y) else 0.0
        model.weights = np.array([1.0 if model.entries is not None else 0.0, 0.0, np.log((share + 1e-6) / (1 - share + 1e-6))])
    return model


def score(df: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, out: str = "score") -> DataFrame:
    """df with the toxicity (0 to 1) of every whole text."""
    plain = Model(weights=model.weights)  # what executors need of it
    return annotate_ratios(df, model, text_col, keep, [out], lambda mean, root: [plain.score(mean, root)])


def op3(spark, sf_dir: str) -> DataFrame:
    """The contract's query: learns from four folds of five, scores every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs.withColumn("held_out", B.fold("doc_id", 5) == 0), model, keep=["doc_id", "held_out"])
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
