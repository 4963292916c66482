import random

import pytest
from pyspark.sql import functions as F

SYLLABLES = {"en": "the an er th in on re at en nd ti es or te of ed is it al ar".split(), "de": "sch ein ich der und ung en er ge ver be ß ü ä ch st te".split(), "fr": "ou é eau le la que tion ment è ç ré on ai eux".split(), "es": "ción mente ñ ado que os es la el ía ar lo".split()}
BAD = ["moron", "idiot", "scum"]


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def make_documents(n=240, seed=1):
    """doc_id, text, lang, quality, toxic of made-up documents: some shouted or full of symbols, some rude, some copies."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = ("en", "en", "de", "fr", "es")[i % 5]
        lines = [sentence(rng, lang, rng.randint(6, 14)).capitalize() + "." for _ in range(rng.randint(2, 6))]
        toxic = int(rng.random() < 0.25)
        if toxic:
            lines = [x.replace(" ", f" {rng.choice(BAD)} ", 1) for x in lines]
        quality = int(rng.random() > 0.25)
        if not quality:
            lines = [x.upper().replace(" ", "!! ") if i % 2 else x.replace(" ", " $$$ ### ") for x in lines]
        text = "\n".join(lines)
        if i % 12 == 11:
            text = rows[-1][1]
            quality, toxic = rows[-1][3], rows[-1][4]
            lang = rows[-1][2]
        rows.append((i, text, lang, quality, toxic))
    return rows


ITEMS = [(i, sentence(random.Random(100 + i), "en", 25)) for i in range(6)] + [(6, "short item here"), (7, None), (8, ""), (9, sentence(random.Random(103), "en", 25))]
EDGES = [None, "", " \n\t ", "12345 !!! ??", "x", "One line only", "Zwei\r\nZeilen\rund mehr", "wort " * 5000, "日本語のテキスト", "a\x00b ﻿"]


@pytest.fixture(scope="session")
def sf(spark, tmp_path_factory):
    """A folder of tables with planted passages and copies, edge cases, repeated rows and columns whose names clash with results."""
    root = tmp_path_factory.mktemp("tables")
    docs = make_documents()
    rows = [(i, t, lang, f"src{i % 7}") for i, t, lang, _, _ in docs]
    rows = [(i, (t + "\n" + ITEMS[i % 6][1] + "\n" if i % 20 == 3 else t), lang, s) for i, t, lang, s in rows]
    rows += [(1000 + k, t, "en" if k % 2 else None, None if k % 3 == 0 else "src0") for k, t in enumerate(EDGES)]
    rows += [(5, rows[5][1], rows[5][2], rows[5][3])] * 2 + [(None, "a row without an id has some words", None, None), (None, None, "en", "src1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for c in ("score", "lang_pred", "fp", "shard", "component_id", "ids", "n_words", "held_out", "sketch", "_id", "label"):
        df = df.withColumn(c, F.lit("clash"))
    df.repartition(5).write.parquet(f"{root}/documents.parquet")
    labels = [(i, q, t) for i, _, _, q, t in docs] + [(3, None, None), (99999, 1, 1), (None, 0, 1), (7, docs[7][3], docs[7][4])]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([*ITEMS, (None, "an item without an id counts for nothing at all here now")], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    pages = [(i, f"http://x/{i}", "<p>same</p>" if i % 3 == 0 else f"<p>page {i}</p>") for i in range(40)] + [(50, None, None), (51, "u", ""), (None, "n", "<p>same</p>"), (0, "http://x/0", "<p>same</p>"), (52, "é\n", "é" * 300_000)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{root}/pages.parquet")
    return str(root)


@pytest.fixture(scope="session")
def empty_sf(spark, sf, tmp_path_factory):
    root = tmp_path_factory.mktemp("empty")
    for t in ("documents", "labels", "benchmark", "pages"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"{root}/{t}.parquet")
    return str(root)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source").collect()
