"""Fill-in-the-middle: texts cut into prefix, middle and suffix, and put back together.

A text is cut at ends of its units (lines by default).  Four numbers follow from the
first 32 hex digits of sha256 of `seed:id`: the first two choose the cuts, modulo the
number of units and one; the third, modulo 100, decides whether the text is transformed
at all; the fourth, whether as suffix-prefix-middle or prefix-suffix-middle.

    psm: <P>prefix<S>suffix<M>middle      spm: <S>suffix<P>prefix<M>middle

A text that is empty or holds a marker stays plain.  No other text holds one, and no
marker begins as it ends, so the first place of a marker in an output is its own, and
`restore` gives the exact text back.

Defined results: a null text is an empty one (plain, no units); a null id counts as no
digits; equal ids and texts, and so repeated rows, give equal outputs.  Ids need not be
unique, as nothing is grouped.  Texts of any length are cut whole: a text and its output
are in memory once each, with eight bytes a unit.  Kept columns named like an output
column are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import text_batches

LINES = r"[^\n]*\n|[^\n]+"
PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass(frozen=True)
class FillInMiddle:
    """Per cent of texts to transform, per cent of those in spm, seed, units and markers."""

    rate: int = 100
    spm_rate: int = 50
    seed: int = 7
    units: str = LINES
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        marks = (self.prefix, self.suffix, self.middle)
        if not all(marks) or any(a != b and a in b for a in marks for b in marks) or len(set(marks)) < 3:
            raise ValueError("markers must not be empty, nor hold each other")
        if any(a[:k] == b[-k:] for a in marks for b in marks for k in range(1, min(len(a), len(b)))):
            raise ValueError("no marker may begin as one ends")

    def numbers(self, doc_id: str) -> list[int]:
        digest = hashlib.sha256(f"{self.seed}:{doc_id}".encode()).hexdigest()
        return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]

    def transform(self, doc_id: str, text: str, finditer: Callable) -> tuple[str, int, str, int | None, int | None]:
        """(output, units, form, code points of the prefix, of the middle)."""
        ends = array("q", (m.end() for m in finditer(text)))
        n = len(ends)
        h1, h2, h3, h4 = self.numbers(doc_id)
        if not text or any(m in text for m in (self.prefix, self.suffix, self.middle)) or h3 % 100 >= self.rate:
            return text, n, PLAIN, None, None
        a, b = (ends[k - 1] if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1))))
        before, after = self.prefix + text[:a], self.suffix + text[b:]
        form = SPM if h4 % 100 < self.spm_rate else PSM
        head = after + before if form == SPM else before + after
        return head + self.middle + text[a:b], n, form, a, b - a

    def restore(self, output: str, form: str) -> str:
        """The exact text of an output of `transform`."""
        if form == PLAIN:
            return output
        first, second = (self.suffix, self.prefix) if form == SPM else (self.prefix, self.suffix)
        at = output.index(second)
        end = output.index(self.middle, at)
        one, two, middle = output[len(first) : at], output[at + len(second) : end], output[end + len(self.middle) :]
        return two + middle + one if form == SPM else one + middle + two


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


OUTPUT = "output string, n long, form string, prefix_chars long, middle_chars long, output_sha256 string"
RESTORED = "restored string, restored_sha256 string"


def _transforming(fim: FillInMiddle) -> Callable[[Column, Column], Column]:
    @F.pandas_udf(OUTPUT)
    def transforming(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        import regex

        finditer = regex.compile(fim.units).finditer
        made = [fim.transform(i or "", t or "", finditer) for i, t in zip(ids, texts, strict=True)]
        found = pd.DataFrame(made, columns=["output", "n", "form", "prefix_chars", "middle_chars"])
        return found.astype({"prefix_chars": "Int64", "middle_chars": "Int64"}).assign(output_sha256=[_sha256(row[0]) for row in made])

    return transforming


def _restoring(fim: FillInMiddle) -> Callable[[Column, Column], Column]:
    @F.pandas_udf(RESTORED)
    def restoring(outputs: pd.Series, forms: pd.Series) -> pd.DataFrame:
        texts = [fim.restore(o, f) for o, f in zip(outputs, forms, strict=True)]
        return pd.DataFrame({"restored": texts, "restored_sha256": [_sha256(t) for t in texts]})

    return restoring


def _with(df: DataFrame, made: Column, names: list[str], keep: list[str]) -> DataFrame:
    """The kept columns and the fields of `made`, which replace columns of their names."""
    keep = [c for c in keep if c not in names]
    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row") if keep else F.lit(None).alias("row"), made.alias("made"))
    return whole.select(*[F.col("row").getField(c).alias(c) for c in keep], *[F.col("made").getField(c).alias(c) for c in names])


def _names(ddl: str) -> list[str]:
    return [field.split()[0] for field in ddl.split(", ")]


def transform(df: DataFrame, fim: FillInMiddle | None = None, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds output, n, form, prefix_chars, middle_chars and output_sha256; the texts
    come and go in Arrow batches of bounded size."""
    made = _transforming(fim or FillInMiddle())(F.col(f"`{doc_id}`").cast("string"), F.col(f"`{text}`"))
    return _with(text_batches(df), made, _names(OUTPUT), df.columns if keep is None else keep)


def restore(df: DataFrame, fim: FillInMiddle | None = None, output: str = "output", form: str = "form", keep: list[str] | None = None) -> DataFrame:
    """Adds the exact text rebuilt from output and form, and its digest."""
    made = _restoring(fim or FillInMiddle())(F.col(f"`{output}`"), F.col(f"`{form}`"))
    return _with(text_batches(df), made, _names(RESTORED), df.columns if keep is None else keep)
