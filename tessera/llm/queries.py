"""The thin queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, language_id, quality, sentencepiece_codec, sharding, simhash, sketch, token_files, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": language_id.op1,
    "op2_warc": warc.op2,
    "op3_toxicity": toxicity.op3,
    "op4_simhash": simhash.op4,
    "op5_quality": quality.op5,
    "op6_sharding": sharding.op6,
    "op7_sentencepiece": sentencepiece_codec.op7,
    "op8_token_files": token_files.op8,
    "op9_decontamination": decontaminate.op9,
    "op10_sketch": sketch.op10,
}
ORACLES: dict[str, str] = {
    "op2_warc": warc.OP2_SQL,
    "op6_sharding": sharding.OP6_SQL,
    "op9_decontamination": decontaminate.OP9_SQL,
}
