"""Queries of the training-data operators, and SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from versoflow.llm import alignment, defects, langid, mixing, packing, splitting, subjects, truncation


def _read(spark: SparkSession, d: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{d}/{n}.parquet") for n in names]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of the sentences of each row that render one another."""
    return alignment.align(*_read(spark, d, "segments", "lang_samples", "glossary_batch"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """row_id and defect of every defective reply."""
    return defects.found(*_read(spark, d, "segments", "books", "lang_samples", "glossary_batch"))


def p2_defect_shares(spark: SparkSession, d: str) -> DataFrame:
    """How often each service's replies have each defect."""
    rows = defects.classify(*_read(spark, d, "segments", "books", "lang_samples", "glossary_batch"))
    return rows.groupBy(F.coalesce("defect", F.lit("none")).alias("defect"), "target_lang").agg(F.count("*").alias("n"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """row_id and field of every value above its limit, from the pieces it was cut into."""
    return splitting.found(*_read(spark, d, "segments", "size_limits"))


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces themselves."""
    return splitting.pieces(*_read(spark, d, "segments", "size_limits"))


def p3_coverage(spark: SparkSession, d: str) -> DataFrame:
    """For every value above its limit: characters that its pieces cover anew, and whether each piece is within the limit,
    follows on, and repeats the overlap of the piece before."""
    cut = p3_pieces(spark, d).drop("piece").join(F.broadcast(_read(spark, d, "size_limits")[0]), "field")
    before = Window.partitionBy("row_id", "field").orderBy("piece_no")  # the pieces of one value
    last_end, last_first = F.lag("end_char").over(before), F.lag("first_char").over(before)
    follows = F.coalesce(F.col("new_from_char") == last_end, F.col("new_from_char") == 0)
    repeats = last_end.isNull() | ((F.col("new_from_char") - F.col("first_char")) >= F.least(F.col("overlap_chars"), last_end - last_first - 1))
    rated = cut.select("row_id", "field", (F.col("end_char") - F.col("new_from_char")).alias("n"), (F.col("end_char") - F.col("first_char") <= F.col("max_chars")).alias("fits"), follows.alias("follows"), repeats.alias("repeats"))
    return rated.groupBy("row_id", "field").agg(F.sum("n").alias("n_chars"), F.bool_and("fits").alias("fits"), F.bool_and("follows").alias("follows"), F.bool_and("repeats").alias("repeats"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """row_id of every row whose translated_text was cut off."""
    return truncation.found(*_read(spark, d, "segments", "books", "lang_samples", "glossary_batch"))


def p4_by_service(spark: SparkSession, d: str) -> DataFrame:
    """Share of cut texts and the limits found, by service."""
    return truncation.by_service(*_read(spark, d, "segments", "books", "lang_samples", "glossary_batch"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Languages of the texts whose label is missing or wrong, or that have several."""
    return langid.found(*_read(spark, d, "segments", "lang_samples", "glossary_batch"))


def p5_languages(spark: SparkSession, d: str) -> DataFrame:
    """Languages, confidence, stretches and label state of every text."""
    return langid.detect_languages(*_read(spark, d, "segments", "lang_samples", "glossary_batch"))


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container of every document, or part of one, for each profile."""
    return packing.assign(*_read(spark, d, "documents", "pack_limits"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers and share of space used, by profile."""
    return packing.fill_report(p6_containers(spark, d))


def p6_coverage(spark: SparkSession, d: str) -> DataFrame:
    """For each profile: documents and parts that have a container, by whether they are once, whole and within capacity."""
    rows = p6_containers(spark, d)
    over = rows.groupBy("profile", "shard", "container_no").agg((F.sum("n_tokens") > F.max("capacity_tokens")).alias("over")).groupBy("profile").agg(F.count_if("over").alias("n_overfull"))
    parts = rows.groupBy("profile", "doc_id").agg(F.count("*").alias("n"), F.max("part_no").alias("last"), F.sum("n_tokens").alias("tokens"), F.max("capacity_tokens").alias("c"))
    divided = parts.withColumn("wrong", (F.col("n") != F.col("last") + 1) | (F.col("n") != F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.col("c")))))
    return divided.groupBy("profile").agg(F.count("*").alias("n_docs"), F.count_if("wrong").alias("n_wrongly_divided")).join(over, "profile")


def p7_selection(spark: SparkSession, d: str) -> DataFrame:
    """The chosen documents with their repeat counts."""
    return mixing.mix(*_read(spark, d, "documents", "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached shares of the sources."""
    documents, targets = _read(spark, d, "documents", "mix_targets")
    return mixing.share_report(mixing.mix(documents, targets), targets)


def p7_caps(spark: SparkSession, d: str) -> DataFrame:
    """For each target: whether its cap on repeats holds and its share is met within a thousandth, or its documents' all."""
    documents, targets = _read(spark, d, "documents", "mix_targets")
    report = mixing.share_report(mixing.mix(documents, targets), targets)
    return report.select("source", (F.col("most_repeats") <= F.col("max_repeats")).alias("within_cap"), (F.abs(F.col("share") - F.col("target_share")) < 0.001).alias("met"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """The subject areas of every document."""
    return subjects.found(*_read(spark, d, "documents", "subject_labels", "subjects"))


def p8_subject_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share of each subject in the corpus, by documents and by sentences."""
    return subjects.corpus_shares(*_read(spark, d, "documents", "subject_labels", "subjects"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p2_found, p2_defect_shares, p3_found, p3_pieces, p3_coverage, p4_found, p4_by_service, p5_found, p5_languages,
        p6_containers, p6_fill, p6_coverage, p7_selection, p7_shares, p7_caps, p8_found, p8_subject_shares,
    )
}

SQL: dict[str, str] = {
    "p3_found": """
        SELECT s.row_id, l.field
        FROM (SELECT row_id, unnest(['original_text', 'chapter_title']) AS field, unnest([original_text, chapter_title]) AS text FROM segments) s
        JOIN size_limits l ON l.field = s.field
        WHERE length(s.text) > l.max_chars
    """,
    "p3_coverage": """
        SELECT s.row_id, l.field, length(s.text) AS n_chars, true AS fits, true AS follows, true AS repeats
        FROM (SELECT row_id, unnest(['original_text', 'chapter_title']) AS field, unnest([original_text, chapter_title]) AS text FROM segments) s
        JOIN size_limits l ON l.field = s.field
        WHERE length(s.text) > l.max_chars
    """,
    "p6_coverage": """
        SELECT profile, (SELECT count(DISTINCT doc_id) FROM documents) AS n_docs, 0 AS n_wrongly_divided, 0 AS n_overfull FROM pack_limits WHERE capacity_tokens > 0
    """,
    "p7_caps": """
        SELECT lower(trim(source)) AS source, true AS within_cap, true AS met FROM mix_targets WHERE source IS NOT NULL GROUP BY 1
    """,
}
