"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tessera.llm.decontaminate import keep_clean
from tessera.llm.language_id import keep_identified
from tessera.llm.near import keep_one
from tessera.llm.quality import keep_good
from tessera.llm.sentencepiece_codec import encode_stage
from tessera.llm.shared import stored

STAGES = [
    ("language_id", keep_identified),
    ("quality", keep_good),
    ("near_dedup", keep_one),
    ("decontamination", keep_clean),
    ("sentencepiece", encode_stage),
]

#: Trained classifiers, connected components and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """The last stage's rows: doc_id, ids and n_tokens of the documents that all stages before it kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
