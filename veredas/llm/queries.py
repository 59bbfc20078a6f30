"""The registered queries of this subpackage: opN_<name>, thin wrappers over the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontaminate, fim, hmm, jaccard, packing, pieces, quality, secrets, substrings, tokencount, tokenfile, urlrules
from .common import table


def op1_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hmm.scores(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_piece_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.segment(table(spark, sf_dir, "documents"))
    each = lambda name: F.transform("n_best", lambda x: x[name])
    return found.select("doc_id", "n_pieces", each("score").alias("scores"), each("n_pieces").alias("lengths"), each("ids_crc32").alias("ids_crc32"), "round_trip")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        F.col("n_hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tokenfile.write(table(spark, sf_dir, "documents"), tokenfile.new_path(spark))
    return tokenfile.digest(tokenfile.read(spark, files))


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(table(spark, sf_dir, "pages"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.fit(docs))
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    base = F.filter("spans", lambda s: s.kind != "crf")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op9_jaccard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("groups", "groups_sha256")


def op12_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fim.transform(table(spark, sf_dir, "documents"))
    back = fim.restored(F.col("output"), F.col("form"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_hmm_scores, op2_piece_segmentation, op3_quality_rules, op4_decontaminate, op5_token_files, op6_url_rules, op7_token_counts, op8_secret_scan, op9_jaccard_groups, op10_suffix_dedup, op11_token_alignment, op12_sequence_packing, op13_fill_in_middle)}


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": quality.ORACLE_SQL, "op4_decontaminate": decontaminate.ORACLE_SQL, "op6_url_rules": urlrules.ORACLE_SQL, "op13_fill_in_middle": fim.ORACLE_SQL}
