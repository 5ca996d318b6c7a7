"""Layout classes: ids, names and groups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Class names in id order.
LABELS = (
    "paragraph_title",
    "image",
    "text",
    "number",
    "abstract",
    "content",
    "figure_title",
    "formula",
    "table",
    "reference",
    "doc_title",
    "footnote",
    "header",
    "algorithm",
    "footer",
    "seal",
    "chart",
    "formula_number",
    "aside_text",
    "reference_content",
)
#: Labels of one line, and of several.
SINGLE_LINE = frozenset({"paragraph_title", "number", "doc_title", "footnote", "header", "algorithm", "footer", "formula_number"})
MULTI_LINE = frozenset({"text", "abstract", "content", "figure_title", "reference", "aside_text", "reference_content"})
TEXT = SINGLE_LINE | MULTI_LINE
FORMULA = "formula"


def is_in(label: Column, group: frozenset[str] | set[str]) -> Column:
    return label.isin(sorted(group)) if group else F.lit(False)


def label_name(label_id: Column) -> Column:
    """The name of a class id; null where there is none."""
    return F.get(F.array(*map(F.lit, LABELS)), label_id.cast("int"))


def label_table(spark):
    """(label_id, label, is_text, is_single_line) as a DataFrame."""
    rows = [(i, x, x in TEXT, x in SINGLE_LINE) for i, x in enumerate(LABELS)]
    return spark.createDataFrame(rows, "label_id int, label string, is_text boolean, is_single_line boolean")
