"""Dictionaries and vocabularies: one symbol per line, order is the id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_symbols(path: str) -> list[str]:
    """The lines of a local file, without their line ends and nothing else: a symbol may be white space."""
    with open(path, encoding="utf-8", newline="\n") as file:
        lines = file.read().split("\n")
    return [x.removesuffix("\r") for x in (lines[:-1] if lines[-1] == "" else lines)]


def read_symbol_table(spark: SparkSession, path: str, first_id: int = 0) -> DataFrame:
    """(id, symbol): `read_symbols` for a file of any store that Spark reads, or a folder
    that holds one, as `write_vocabulary` leaves it."""
    file = spark.read.format("binaryFile").option("pathGlobFilter", "[!_.]*").load(path).where("length > 0")
    lines = F.split(F.decode("content", "UTF-8"), "\n", -1)
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)
    rows = file.select(F.posexplode(lines).alias("place", "line"))
    return rows.select((F.col("place") + first_id).alias("id"), F.regexp_replace("line", r"\r\z", "").alias("symbol"))


def symbol_table(spark: SparkSession, symbols: list[str], first_id: int = 1) -> DataFrame:
    """(class_id, symbol); recognition ids begin at 1, as 0 is the blank."""
    return spark.createDataFrame([(i, s) for i, s in enumerate(symbols, first_id)], "class_id int, symbol string")


def read_yaml_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(token_id, token) of a formula model's YAML file: its tokenizer's vocabulary, with
    the added tokens in place of equal ids.  Fails if ids aren't contiguous from 0."""
    import yaml  # only this reader needs it

    with open(path, encoding="utf-8") as file:
        tokenizer = yaml.safe_load(file)["PostProcess"]["character_dict"]["fast_tokenizer_file"]
    schema = "token_id int, token string"
    vocab = spark.createDataFrame([(i, t) for t, i in tokenizer["model"]["vocab"].items()], schema)
    added = spark.createDataFrame([(t["id"], t["content"]) for t in tokenizer["added_tokens"]], schema)
    return overlay_vocabulary(vocab, added)


def overlay_vocabulary(vocab: DataFrame, added: DataFrame) -> DataFrame:
    """(token_id, token): a vocabulary with added tokens in place of equal ids.

    Fails if ids aren't contiguous from 0.
    """
    merged = vocab.join(added, "token_id", "left_anti").select("token_id", "token").unionByName(added.select("token_id", "token"))
    n, most, least = merged.agg(F.countDistinct("token_id"), F.max("token_id"), F.min("token_id")).first()
    if n and (least != 0 or most != n - 1):
        raise ValueError(f"token ids aren't contiguous: {n} ids from {least} to {most}")
    return merged


def write_vocabulary(table: DataFrame, path: str) -> None:
    """Writes a vocabulary (token_id, token) as one file of a folder, a token a line."""
    vocabulary_lines(table).coalesce(1).write.option("lineSep", "\n").text(path)


def vocabulary_lines(table: DataFrame) -> DataFrame:
    """The lines of a vocabulary file, in order of id."""
    return table.orderBy("token_id").select("token")
