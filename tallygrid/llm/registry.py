"""The registered queries of the training-data operators, and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallygrid.llm import (
    chat, decontaminate, jaccard, lattice, maintext, negatives, oracle, packing, periodic, quality, secrets, suffixes, tokenfile, toxicity,
)

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = decontaminate.benchmark_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.withColumn("similarity", F.round("similarity", 6))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.repetition_metrics(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), keep_ids=False).drop("ids")


def op4_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.lattice_scores(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents")).drop("blob")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"), keep_bytes=False)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents")).drop("thash")


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintext.extract(table(spark, sf_dir, "pages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.read_tokens(spark, tokenfile.write_tokens(table(spark, sf_dir, "documents")))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("id") % 100 == 0)


def planted_runs(documents: DataFrame) -> DataFrame:
    """doc_id and text, where the texts of one in ten ids repeat a stretch of their words from some word on."""
    rows = documents.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    rows = rows.withColumn("words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    rows = rows.withColumn("n", F.size("words").cast("long")).withColumn("g", F.floor(F.col("h") / 10))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    repeated = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.get("words", place(i).cast("int")))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_digests(periodic.periodic_runs(planted_runs(table(spark, sf_dir, "documents"))))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], said.schema)
    return chat.conversation_digests(chat.read_turns(chat.format_turns(said.unionByName(more))))


def queries() -> dict[str, Query]:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_quality_rules": op2_quality_rules,
        "op3_packing": op3_packing,
        "op4_lattice_scores": op4_lattice_scores,
        "op5_secret_scan": op5_secret_scan,
        "op6_suffix_dedup": op6_suffix_dedup,
        "op7_jaccard_join": op7_jaccard_join,
        "op8_main_text": op8_main_text,
        "op9_toxicity": op9_toxicity,
        "op10_token_files": op10_token_files,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_chat_format": op13_chat_format,
    }


def oracle_sql() -> dict[str, str]:
    """The other queries are tested against brute force, exact round trips or held-out accuracy."""
    return {
        "op1_decontamination": oracle.decontamination_sql(),
        "op2_quality_rules": oracle.quality_sql(),
        "op5_secret_scan": oracle.secrets_sql(),
        "op7_jaccard_join": oracle.jaccard_sql(),
        "op11_hard_negatives": oracle.negatives_sql(),
        "op13_chat_format": oracle.chat_sql(),
    }
