"""The catalogue of a service's models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versoflow.functions.text import thousands

# The method that a usable model supports, kinds of input, and features.
GENERATES = "generateContent"
ALL_INPUTS, IMAGE_INPUT, TEXT_INPUT = "文本, 图像, 音频, 视频 (多模态)", "文本, 图像", "纯文本"
LARGE_CONTEXT, GROUNDED, STANDARD = "大上下文", "事实核查/归因", "标准功能"


def abilities(name: Column, methods: Column) -> tuple[Column, Column]:
    """(kinds of input, features) of a model by its name and methods."""
    has = lambda x: F.contains(name, F.lit(x))
    usable = F.array_contains(methods, GENERATES)
    multi = usable & has("gemini") & (has("vision") | has("1.5") | has("2.5") | has("flash"))
    inputs = F.when(multi, ALL_INPUTS).when(usable & has("vision"), IMAGE_INPUT).otherwise(TEXT_INPUT)
    features = F.concat_ws(", ", F.when(multi, LARGE_CONTEXT), F.when(has("aqa"), GROUNDED))
    return inputs, F.when(features == "", STANDARD).otherwise(features)


def listing(models: DataFrame) -> DataFrame:
    """Usable models by name: name, inputs, features, token limits with separators (``N/A`` if unknown)."""
    inputs, features = abilities(F.col("name"), F.col("methods"))
    usable = models.where(F.array_contains("methods", GENERATES))
    return usable.select("name", inputs.alias("inputs"), features.alias("features"), thousands("input_token_limit").alias("input_limit"), thousands("output_token_limit").alias("output_limit")).orderBy("name")


def markdown_table(rows: DataFrame) -> DataFrame:
    """The listing as one Markdown table: a catalogue is small."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *rows.columns), F.lit(" |"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", line.alias("line")))), lambda r: r["line"]), "\n")
    head = "| " + " | ".join(rows.columns) + " |\n|" + "---|" * len(rows.columns) + "\n"
    return rows.agg(F.concat(F.lit(head), body).alias("table"))
