"""Language identification by hierarchical discrimination.

A linear support vector machine for each language family says which family a text belongs to; within
the family, one-versus-one linear machines vote between its languages. All machines read the same
vector: Hellinger-scaled frequencies of hashed byte n-grams (2 and 3 bytes) over letters and word gaps.

Edge cases: a null text, an empty text and a text without letters give `und` with score 0. A language
alone in its family needs no machine inside it. With one learned language everything else is that
language; with none, everything is `und`. Repeated rows are predicted alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as B

DIM = 1 << 13

#: Texts whose dense feature rows (DIM numbers each) are held at a time.
DENSE_ROWS = 128

# Families of languages by ISO 639-1 code.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fy", "is", "lb", "nl", "no", "sv", "yi"],
    "romance": ["ca", "es", "fr", "gl", "it", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
    "baltic": ["lt", "lv"],
    "celtic": ["br", "cy", "ga", "gd"],
    "turkic": ["az", "kk", "tr", "uz"],
    "indo-aryan": ["bn", "gu", "hi", "mr", "ne", "pa", "ur"],
    "semitic": ["am", "ar", "he", "mt"],
    "austronesian": ["id", "jv", "ms", "tl"],
}


def family_of(lang: str) -> str:
    """The family of a code; a language of none of them is a family of its own."""
    code = lang.split("-")[0].split("_")[0].lower()
    return next((f for f, langs in FAMILIES.items() if code in langs), f"own:{lang}")


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """rows x DIM: square roots of the shares of hashed byte bigrams and trigrams; zeros without letters."""
    n, rows = len(data), len(offsets) - 1
    out = np.zeros((rows, DIM), np.float32)
    if n < 3:
        return out
    low = B.LOWER[data]
    text = np.where(B.LETTER_BYTES[low], low, np.uint8(32)).astype(np.uint32)
    row = np.repeat(np.arange(rows, dtype=np.int64), np.diff(offsets))
    pair = text[:-1] << np.uint32(8) | text[1:]
    ok = (row[:-1] == row[1:]) & (pair != 0x2020)
    tri = pair[:-1] << np.uint32(8) | text[2:]
    ok3 = ok[:-1] & ok[1:]
    slot = lambda x: (x * np.uint32(2654435761) >> np.uint32(32 - 13)).astype(np.int64)
    at = np.concatenate((row[:-1][ok] * DIM + slot(pair[ok]), row[:-2][ok3] * DIM + slot(tri[ok3] + np.uint32(0x5BD1E995))))
    out = np.bincount(at, minlength=rows * DIM).reshape(rows, DIM).astype(np.float32)
    total = out.sum(1, keepdims=True)
    return np.sqrt(out / np.maximum(total, 1))


def blocks(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Rows and their features, DENSE_ROWS at a time, so that the working set doesn't follow DIM times the slice's rows."""
    for a, b in B.slices(offsets, rows=DENSE_ROWS):
        yield slice(a, b), features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def lettered(data: np.ndarray, offsets: np.ndarray, col: pa.Array) -> np.ndarray:
    """Whether each text has a letter of any script."""
    if len(data) == 0:
        return np.zeros(len(offsets) - 1, bool)
    seen = np.concatenate(([0], np.cumsum(B.LETTER_BYTES[B.LOWER[data]] & (data < 128))))
    out = seen[offsets[1:]] > seen[offsets[:-1]]
    for i in np.flatnonzero(~out & (offsets[1:] > offsets[:-1])):
        out[i] = any(c.isalpha() for c in col[int(i)].as_py())
    return out


@dataclass
class Rows:
    """Sparse feature rows: row i has the values x[first[i] : first[i + 1]] at the places `at` of the same range."""

    at: np.ndarray
    x: np.ndarray
    first: np.ndarray

    @staticmethod
    def of(rows: list[tuple[np.ndarray, np.ndarray]]) -> Rows:
        first = np.concatenate(([0], np.cumsum([len(a) for a, _ in rows]))).astype(np.int64)
        empty = np.zeros(0, np.int16), np.zeros(0, np.float32)
        return Rows(np.concatenate([a for a, _ in [*rows, empty]]), np.concatenate([v for _, v in [*rows, empty]]), first)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        return self.at[self.first[i] : self.first[i + 1]], self.x[self.first[i] : self.first[i + 1]]


def fit_svm(rows: Rows, own: np.ndarray, y: np.ndarray, c: float = 10.0, epochs: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """A linear machine on the rows numbered `own` with squared hinge loss by dual coordinate descent; y is +1 or -1, classes weigh alike."""
    n = len(own)
    w, bias, alpha = np.zeros(DIM), 0.0, np.zeros(n)
    weight = np.where(y > 0, n / (2 * max(1, (y > 0).sum())), n / (2 * max(1, (y < 0).sum())))
    soft = 1 / (2 * c * weight)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(n):
            at, x = rows[own[i]]
            g = y[i] * (x @ w[at] + bias) - 1 + soft[i] * alpha[i]
            new = max(alpha[i] - g / (x @ x + 1 + soft[i]), 0.0)
            if step := new - alpha[i]:
                w[at] += step * y[i] * x
                bias += step * y[i]
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w.astype(np.float32), float(bias)


@dataclass
class Model:
    families: list[str]
    langs: dict[str, list[str]]
    weights: np.ndarray  # DIM x machines: one for each family, then one for each pair within a family
    biases: np.ndarray
    pairs: list[tuple[str, int, int]]
    sharpness: float = 4.0

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Languages and scores of feature rows."""
        m = x @ self.weights + self.biases
        nf = len(self.families)
        fam = m[:, :nf].argmax(1)
        if nf > 1:
            top = np.partition(m[:, :nf], nf - 2, axis=1)
            p = 1 / (1 + np.exp(-self.sharpness * (top[:, -1] - top[:, -2])))
        else:
            p = np.ones(len(x))
        lang = np.empty(len(x), dtype=object)
        for k, f in enumerate(self.families):
            own, of = fam == k, self.langs[f]
            if not own.any():
                continue
            votes, least = np.zeros((own.sum(), len(of))), np.full((own.sum(), len(of)), np.inf)
            for j, (g, a, b) in enumerate(self.pairs):
                if g == f:
                    margin = m[own, nf + j]
                    votes[:, a] += margin > 0
                    votes[:, b] += margin <= 0
                    least[:, a] = np.minimum(least[:, a], margin)
                    least[:, b] = np.minimum(least[:, b], -margin)
            if len(of) > 1:
                best = (votes + 1e-3 * np.tanh(least)).argmax(1)
                p[own] *= 1 / (1 + np.exp(-self.sharpness * least[np.arange(len(best)), best]))
            else:
                best = np.zeros(own.sum(), int)
            lang[own] = np.array(of, dtype=object)[best]
        return lang, p


def sample_features(df: DataFrame, text_col: str, label_col: str) -> tuple[Rows, np.ndarray]:
    """Feature rows and labels of a bounded sample, sparse from the executors on."""

    def scorer():
        def f(data, offsets, col):
            ok, at, values = lettered(data, offsets, col), [], []
            for rows, x in blocks(data, offsets):
                at += [np.flatnonzero(r).astype(np.int16).tobytes() if k else None for r, k in zip(x, ok[rows])]
                values += [r[r > 0].tobytes() for r in x]
            return [at, values]

        return f

    got = B.annotate(df, text_col, [T.StructField("_at", T.BinaryType()), T.StructField("_x", T.BinaryType())], scorer, keep=[label_col]).where("_at is not null").collect()
    got = sorted((r[label_col], bytes(r["_at"]), bytes(r["_x"])) for r in got)
    return Rows.of([(np.frombuffer(a, np.int16), np.frombuffer(x, np.float32)) for _, a, x in got]), np.array([r[0] for r in got], dtype=object)


def train(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_label: int = 600, seed: int = 11, most_labels: int = 512, most_rows: int = 24_000) -> Model:
    """Fits all machines on a bounded sample by a hash of the id: about `per_label` rows of each of the `most_labels` most frequent languages, `most_rows` in all."""
    sample = B.bounded_sample(rows.where(F.col(text_col).isNotNull()), id_col, label_col, per_label, seed, most_labels, most_rows)
    x, y = sample_features(sample, text_col, label_col)
    langs: dict[str, list[str]] = {}
    for lang in sorted(set(y)):
        langs.setdefault(family_of(lang), []).append(lang)
    families = sorted(langs)
    fam, every = np.array([family_of(v) for v in y], dtype=object), np.arange(len(y))
    machines = [fit_svm(x, every, np.where(fam == f, 1.0, -1.0)) if len(families) > 1 else (np.zeros(DIM, np.float32), 0.0) for f in families]
    pairs = [(f, a, b) for f in families for a in range(len(langs[f])) for b in range(a + 1, len(langs[f]))]
    for f, a, b in pairs:
        own = np.flatnonzero((y == langs[f][a]) | (y == langs[f][b]))
        machines.append(fit_svm(x, own, np.where(y[own] == langs[f][a], 1.0, -1.0)))
    weights = np.stack([w for w, _ in machines], 1) if machines else np.zeros((DIM, 0), np.float32)
    return Model(families, langs, weights.astype(np.float32), np.array([b for _, b in machines], np.float32), pairs)


def identify(df: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """df with the predicted language and its score (0 to 1) of every whole text."""

    def scorer():
        def f(data, offsets, col):
            ok = lettered(data, offsets, col)
            lang, score = np.full(len(ok), "und", dtype=object), np.zeros(len(ok))
            if model.families and ok.any():
                for rows, x in blocks(data, offsets):
                    own = ok[rows]
                    got, p = model.predict(x[own])
                    lang[rows][own], score[rows][own] = got, p
            return [pa.array(lang.tolist(), pa.string()), pa.array(score, pa.float64())]

        return f

    return B.annotate(df, text_col, [T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())], scorer, keep)


def op1(spark, sf_dir: str) -> DataFrame:
    """The contract's query: learns from two thirds of the documents and predicts all."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = B.fold("doc_id", 3) == 1
    model = train(docs.where(~held))
    return identify(docs.withColumn("held_out", held), model, keep=["doc_id", "held_out"])


def keep_identified(spark, docs: DataFrame, sf_dir: str, least: float = 0.3) -> DataFrame:
    """Pipeline stage: keeps the rows of docs whose language is told with a score of `least` or more.

    Learns from the rows at hand that have a language, by the folds of the query. Null, empty and letterless
    texts are `und` and go; rows with a null id or language, and repeated rows, are judged by their text alone
    and stay or go together. Without any learned language every row goes. An empty table stays empty. Columns
    of any name pass through.
    """
    model = train(docs.where(B.fold("doc_id", 3) != 1))
    lang, score = B.free(docs, "_lang_pred"), B.free(docs, "_lang_score")
    return identify(docs, model, lang_out=lang, score_out=score).where((F.col(lang) != "und") & (F.col(score) >= least)).select(*docs.columns)
