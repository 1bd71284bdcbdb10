"""Queries of the operators for training data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.garbled import garbled_pages

    return garbled_pages(table(spark, sf_dir, "archive_records")).select("record_seq")


def p1_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.garbled import garbled_pages

    return garbled_pages(table(spark, sf_dir, "archive_records"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.dedup import deduplicated

    return deduplicated(table(spark, sf_dir, "archive_records"), together=3).select("accepted_seq", "duplicate_seq")


def p2_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.dedup import History, deduplicated

    history = History(spark)
    deduplicated(table(spark, sf_dir, "archive_records"), history, together=3)
    return history.representatives()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.spam import spam_pages

    return spam_pages(table(spark, sf_dir, "archive_records")).select("record_seq")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.repeated_lines import repeated_lines

    return repeated_lines(table(spark, sf_dir, "archive_records")).select("record_seq", "line_no")


def p5_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.repeated_lines import line_clusters

    return line_clusters(table(spark, sf_dir, "archive_records"))


def p5_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.repeated_lines import without_repeated

    return without_repeated(table(spark, sf_dir, "archive_records"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.residue import residue_pages

    return residue_pages(table(spark, sf_dir, "archive_records")).select("record_seq").distinct()


def p6_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.residue import residue_pages

    return residue_pages(table(spark, sf_dir, "archive_records"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.main_content import main_lines

    return main_lines(table(spark, sf_dir, "archive_records"))


def p7_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.main_content import main_texts

    return main_texts(table(spark, sf_dir, "archive_records"))


def _capacity(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "container_kinds").filter("container_kind = 'standard'").first().capacity_tokens


def _filled(spark: SparkSession, sf_dir: str, by: str = "best_fit") -> DataFrame:
    from quarry.llm import containers

    return containers.filled(table(spark, sf_dir, "documents"), _capacity(spark, sf_dir), plan=getattr(containers, by))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.containers import oversized

    return oversized(_filled(spark, sf_dir))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled(spark, sf_dir)


def _usage(spark: SparkSession, sf_dir: str, by: str) -> DataFrame:
    from pyspark.sql import functions as F

    each = _filled(spark, sf_dir, by).groupBy("container").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("items"))
    share = (F.sum("used") / F.count("*") / _capacity(spark, sf_dir)).alias("filled_share")
    return each.agg(F.count("*").alias("n_containers"), F.sum("items").alias("n_items"), F.sum("used").alias("n_tokens"), F.max("used").alias("fullest"), share)


def p8_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _usage(spark, sf_dir, "best_fit")


def p8_bucket_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for batches inside optimal length buckets."""
    return _usage(spark, sf_dir, "by_buckets")


def p8_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, whole: whether the pieces of a document follow one another without a gap, each once."""
    from pyspark.sql import functions as F

    capacity = _capacity(spark, sf_dir)
    placed = _filled(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("piece").alias("pieces"), F.max("piece").alias("last"), F.sum("n_tokens").alias("tokens"), F.max(F.col("first_token") + F.col("n_tokens")).alias("end"))
    whole = (F.col("n") == F.col("pieces")) & (F.col("last") == F.col("n") - 1) & (F.col("tokens") == F.col("end")) & (F.col("tokens") > F.col("last") * capacity)
    return placed.select("doc_id", whole.alias("whole"))


def p9_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.mixing import selection

    return selection(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p9_feasible_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for the largest mix in which all sources that exist can keep their shares."""
    from quarry.llm.mixing import FEASIBLE, shares

    return shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), FEASIBLE)


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.mixing import shares

    return shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.subjects import document_subjects

    return document_subjects(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_labels"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subjects(spark, sf_dir).select("doc_id", "subject")


def p10_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.subjects import composition

    return composition(table(spark, sf_dir, "documents"), _subjects(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_restored, p2_found, p2_representatives, p3_found, p5_found, p5_clusters, p5_cleaned, p6_found, p6_kinds, p7_found, p7_texts,
        p8_found, p8_containers, p8_usage, p8_bucket_usage, p8_placed, p9_selection, p9_shares, p9_feasible_shares, p10_found, p10_composition,
    )
}
ORACLE: dict[str, str] = {
    "p8_placed": "SELECT doc_id, TRUE AS whole FROM documents WHERE length(text) > 0",
}
