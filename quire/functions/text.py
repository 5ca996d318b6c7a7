"""String functions as Column expressions."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def utrim(text: Column) -> Column:
    """Unicode white space off both ends (trim() takes ASCII spaces alone)."""
    return F.regexp_replace(text, r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$", "")


def is_blank(text: Column) -> Column:
    return F.length(utrim(text)) == 0


def literal_array(items: list[str]) -> Column:
    """A foldable array of strings: one literal in the plan, however long."""
    return F.from_json(F.lit(json.dumps(items)), "array<string>")


def byte_level_value(code: Column) -> Column:
    """The byte that a byte-level letter stands for: itself below 256, else the
    n-th byte that isn't printable (0 beyond the last)."""
    n = code - 256
    return F.when(code < 256, code).when(n < 33, n).when(n < 67, n + 94).when(n == 67, F.lit(173)).otherwise(F.lit(0))


def byte_level_text(text: Column) -> Column:
    """Byte-level letters to UTF-8 text; broken sequences become U+FFFD."""
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    pairs = F.transform(letters, lambda c: F.lpad(F.hex(byte_level_value(F.ascii(c)).cast("long")), 2, "0"))
    return F.make_valid_utf8(F.unhex(F.array_join(pairs, "")).cast("string"))


def byte_level_letters(text: Column) -> Column:
    """The byte-level letters of a text's UTF-8 bytes: printable bytes are themselves, the
    n-th of the others is the letter 256 + n."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    letters = {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(others)}
    table = literal_array([letters[b] for b in range(256)])
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)"), F.lit(1))
    return F.array_join(F.transform(pairs, lambda p: F.get(table, F.conv(p, 16, 10).cast("int"))), "")
