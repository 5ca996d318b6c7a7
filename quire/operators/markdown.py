"""Recognised text to paragraphs and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import is_blank, utrim


def keep_recognised(rows: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Rows of enough confidence whose text isn't blank, with the text trimmed."""
    sure = ~F.isnan("confidence") & (F.col("confidence") >= F.lit(threshold).cast(rows.schema["confidence"].dataType))
    return rows.where(sure & ~is_blank(F.col("text"))).withColumn("text", utrim(F.col("text")))


def paragraph(label: Column, texts: Column) -> Column:
    """Markdown of a region's ordered texts; no text gives the empty string."""
    return (
        F.when(F.size(texts) == 0, F.lit(""))
        .when(label == "doc_title", F.concat(F.lit("# "), F.array_join(texts, " ")))
        .when(label == "paragraph_title", F.concat(F.lit("## "), F.array_join(texts, " ")))
        .otherwise(F.array_join(texts, "\n"))
    )


def region_markdown(rows: DataFrame, by: list[str], order: str, label: str = "label") -> DataFrame:
    """(by, label, content): one row per region of recognised rows."""
    grouped = rows.groupBy(*by, label).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "text"))).alias("lines"))
    return grouped.select(*by, label, paragraph(F.col(label), F.transform("lines", lambda s: s["text"])).alias("content"))


def formula_markdown(latex: Column) -> Column:
    """A display formula; blank LaTeX gives the empty string."""
    return F.when(is_blank(latex), F.lit("")).otherwise(F.concat(F.lit("$$\n"), utrim(latex), F.lit("\n$$")))


def documents(paragraphs: DataFrame, order: str = "para_idx") -> DataFrame:
    """(page_id, markdown): non-empty paragraphs in order, a blank line between."""
    kept = paragraphs.where("content <> ''")
    grouped = kept.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "content"))).alias("ps"))
    return grouped.select("page_id", F.array_join(F.transform("ps", lambda s: s["content"]), "\n\n").alias("markdown"))
