"""What operators hold in a worker: working sets that don't follow the rows of a slice, and nothing kept for another operator's task."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import language_id, sentencepiece_codec, textbytes

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_op1_features_of_a_slice_are_not_held_at_once(monkeypatch):
    rng = np.random.default_rng(3)
    langs = {"a": ["a0", "a1"], "b": ["b0"]}
    model = language_id.Model(["a", "b"], langs, rng.normal(size=(language_id.DIM, 3)).astype(np.float32), np.zeros(3, np.float32), [("a", 0, 1)])
    texts = [None, "", "12 3", *("".join(map(chr, rng.integers(97, 123, 60))) for _ in range(textbytes.SLICE_ROWS - 3))]
    col = pa.array(texts, pa.string())
    data, offsets = textbytes.column_bytes(col)
    monkeypatch.setattr(textbytes, "annotate", lambda df, text, fields, scorer, *a, **b: scorer())
    f = language_id.identify(None, model)
    tracemalloc.start()
    lang, score = f(data, offsets, col)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 << 20
    want, p = model.predict(language_id.features(data, offsets))
    assert lang.to_pylist() == ["und"] * 3 + want[3:].tolist()
    assert score.to_pylist() == pytest.approx([0.0] * 3 + p[3:].tolist(), abs=1e-5)


def test_a_codec_goes_when_another_operator_has_the_worker(spark):
    path = sentencepiece_codec.model_path()
    texts = spark.createDataFrame([(i, f"some text {i}") for i in range(20)], "doc_id long, text string").coalesce(1)
    first = sentencepiece_codec.codec(path)
    textbytes.take_over(sentencepiece_codec.OWN)
    assert sentencepiece_codec.codec(path) is first
    textbytes.take_over()
    assert sentencepiece_codec.codec.cache_info().currsize == 0
    textbytes.take_over()
    # and the tasks say so: whether a task of another operator finds a codec that a task before it left in the worker
    found = lambda: lambda data, offsets, col: [pa.array([sentencepiece_codec.codec.cache_info().currsize] * len(col), pa.int64())]
    seen = lambda **how: [r.n for r in textbytes.annotate(texts, "text", [textbytes.T.StructField("n", textbytes.T.LongType())], found, ["doc_id"], **how).collect()]
    want = [r.ids for r in sentencepiece_codec.encode(texts, path).orderBy("doc_id").collect()]
    assert set(seen()) == {0}
    assert [r.ids for r in sentencepiece_codec.encode(texts, path).orderBy("doc_id").collect()] == want


def test_batches_are_bounded_by_bytes_unless_the_session_says_otherwise(spark):
    rows = spark.createDataFrame([(i, "x" * 100_000) for i in range(100)], "doc_id long, text string").coalesce(1)
    size = [textbytes.T.StructField("n", textbytes.T.LongType())]
    sizes = lambda: textbytes.annotate(rows, "text", size, lambda: lambda data, offsets, col: [pa.array([col.buffers()[-1].size] * len(col), pa.int64())], ["doc_id"])
    spark.conf.unset(KEY)
    try:
        assert max(r.n for r in sizes().collect()) <= textbytes.BATCH_BYTES + 200_000
        spark.conf.set(KEY, "1m")
        assert max(r.n for r in sizes().collect()) <= 1_300_000
        assert spark.conf.get(KEY) == "1m"
    finally:
        spark.conf.unset(KEY)
