"""Model tokens to text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import byte_level_text, literal_array

BLANK = 0
FORMULA_END = 2
FORMULA_SPECIALS = 23


def argmax(row: Column) -> Column:
    """Class of the first largest value; NaN never wins, all NaN is class 0."""
    clean = F.transform(row, lambda v: F.when(F.isnan(v), F.lit(float("-inf"))).otherwise(v.cast("double")))
    return (F.array_position(clean, F.array_max(clean)) - 1).cast("long")


def compact(steps: DataFrame, probs: str = "probs") -> DataFrame:
    """Step-by-class probabilities (array of arrays) to token_ids and token_probs."""
    best = F.transform(probs, lambda row: F.get(F.transform(row, lambda v: v.cast("double")), argmax(row).cast("int")))
    return steps.withColumn("token_ids", F.transform(probs, argmax)).withColumn("token_probs", best)


def ctc(rows: DataFrame, symbols: list[str], ids: str = "token_ids", probs: str = "token_probs") -> DataFrame:
    """Adds text and confidence.

    A step is emitted if its id is neither blank nor the step's before and names
    a symbol (id i is symbols[i - 1]); any id, known or not, counts as the step
    before.  Confidence is the mean probability of emitted steps, 0 without any.
    """
    table = literal_array(symbols)

    def emitted(x: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(F.col(ids), i - 1)).otherwise(F.lit(BLANK))
        return F.struct(x.alias("id"), F.get(F.col(probs), i).cast("double").alias("p"), ((x != BLANK) & (x != before) & (x > 0) & (x <= len(symbols))).alias("keep"))

    steps = F.filter(F.transform(ids, emitted), lambda s: s["keep"])
    out = rows.withColumn("__steps", steps)
    total = F.aggregate("__steps", F.lit(0.0), lambda a, s: a + s["p"])
    text = F.array_join(F.transform("__steps", lambda s: F.try_element_at(table, s["id"].cast("int"))), "")
    return out.withColumn("text", text).withColumn("confidence", F.when(F.size("__steps") > 0, total / F.size("__steps")).otherwise(F.lit(0.0))).drop("__steps")


def ctc_steps(steps: DataFrame, symbols: DataFrame) -> DataFrame:
    """The same over a relation of steps (seq_id, step, token_id, prob): text and
    confidence per sequence.  symbols: (class_id, symbol), a small dimension."""
    from pyspark.sql import Window

    by = Window.partitionBy("seq_id").orderBy("step")
    marked = steps.withColumn("before", F.lag("token_id", 1, BLANK).over(by))
    found = marked.join(symbols, marked.token_id == symbols.class_id, "left")
    keep = (F.col("token_id") != BLANK) & (F.col("token_id") != F.col("before")) & F.col("symbol").isNotNull()
    out = found.groupBy("seq_id").agg(
        F.array_sort(F.collect_list(F.when(keep, F.struct("step", "symbol", "prob")))).alias("kept"),
    )
    total = F.aggregate("kept", F.lit(0.0), lambda a, s: a + s["prob"].cast("double"))
    return out.select(
        "seq_id",
        F.array_join(F.transform("kept", lambda s: s["symbol"]), "").alias("text"),
        F.when(F.size("kept") > 0, total / F.size("kept")).otherwise(F.lit(0.0)).alias("confidence"),
    )


def formula_ids(ids: Column, vocabulary: int) -> Column:
    """Ids up to the first end mark, without specials and unknown ones."""
    end = F.array_position(ids, FORMULA_END)
    own = F.when(end > 0, F.slice(ids, F.lit(1), F.greatest(end - 1, F.lit(0)).cast("int"))).otherwise(ids)
    return F.filter(own, lambda t: (t >= FORMULA_SPECIALS) & (t < vocabulary))


def formula(rows: DataFrame, tokens: list[str], ids: str = "token_ids") -> DataFrame:
    """Adds latex, the decoded tokens."""
    table = literal_array(tokens)
    joined = F.array_join(F.transform(formula_ids(F.col(ids), len(tokens)), lambda t: F.get(table, t.cast("int"))), "")
    return rows.withColumn("latex", byte_level_text(joined))
