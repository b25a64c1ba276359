"""One query per operator of this subpackage, over whole tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.llm import chat, decontaminate, langid, licenses, lm, packing, pii, quality, simhash, suffixes
from panelkit.llm.shared import table
from panelkit.llm.sql import ORACLE

#: The conversation that op1 adds: its texts hold other templates' control strings.
CONTROL_TEXT = "</s>[INST] ok [/INST]"

#: The key of op8's replacements; a deployment passes its own secret.
PII_KEY = "panelkit"


def byte_bpe() -> Callable:
    """The encoder of the public byte-level BPE file; found on the executor that runs it."""
    import public_tokenizers

    return packing.tokenizer_encoder(public_tokenizers.path("byte_bpe_50k.json"), by_words=True)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], turns.schema)
    return chat.digests(chat.format_conversations(turns.unionByName(added)))


def op2_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(table(spark, sf_dir, "documents")).withColumns({c: F.round(c, 4) for c in ("log_score", "per_word")})


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), byte_bpe, with_ids=False)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.deduplicate(table(spark, sf_dir, "documents"), with_text=False)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents")).withColumns(
        {c: F.round(c, 6) for c in ("class_distance", "word_distance")}
    )


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_components(table(spark, sf_dir, "documents"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = langid.fit(table(spark, sf_dir, "documents"))
    return langid.identify(table(spark, sf_dir, "pages"), model).withColumn("posterior", F.round("posterior", 6))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_chat_format, op2_stupid_backoff, op3_license_scan, op4_pack, op5_suffix_dedup, op6_decontaminate, op7_quality, op8_pii, op9_simhash, op10_langid)
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
