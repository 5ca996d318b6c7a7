"""Fill-in-the-middle: exact round trips, and a plain version of the cuts."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import fim

PARTS = st.lists(st.sampled_from(["a", "\n", "<", ">", "P", "S", "M", "<P", "é", "日本", "\r\n", " ", " ", "𝄞"]), max_size=30).map("".join)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(doc_id, text, rate=100, spm_rate=50):
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = sha(f"7:{doc_id}")
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return text, len(lines), "plain", None, None
    x, y, z = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h[3] % 100 < spm_rate:
        return f"<S>{z}<P>{x}<M>{y}", len(lines), "spm", len(x), len(y)
    return f"<P>{x}<S>{z}<M>{y}", len(lines), "psm", len(x), len(y)


@settings(max_examples=300, deadline=None)
@given(st.integers(-5, 10**6), PARTS, st.sampled_from([0, 40, 100]), st.sampled_from([0, 50, 100]))
def test_cuts_and_round_trip(doc_id, text, rate, spm_rate):
    import regex

    own = fim.FillInMiddle(rate=rate, spm_rate=spm_rate)
    made = own.transform(str(doc_id), text, regex.compile(own.units).finditer)
    assert made == plain(doc_id, text, rate, spm_rate)
    assert own.restore(made[0], made[2]) == text


def test_markers():
    for bad in ({"prefix": ""}, {"prefix": "<S>"}, {"prefix": "<S>x"}, {"prefix": "ab", "suffix": "ca"}):
        with pytest.raises(ValueError):
            fim.FillInMiddle(**bad)
    own = fim.FillInMiddle(prefix="<|fim_prefix|>", suffix="<|fim_suffix|>", middle="<|fim_middle|>", units=r".")
    import regex

    for k in range(50):
        out, _, form, _, _ = own.transform(str(k), "<|fim_prefix" * 3, regex.compile(own.units).finditer)
        assert own.restore(out, form) == "<|fim_prefix" * 3


def test_odd_texts(spark, odd_docs, no_docs):
    clash = odd_docs.selectExpr("*", "'x' AS output", "2 AS n", "'y' AS form", "'z' AS restored", "'r' AS row", "'m' AS made")
    found = fim.restore(fim.transform(clash)).collect()
    assert len(found) == clash.count()
    for r in found:
        text = r.text or ""
        assert (r.output, r.n, r.form, r.prefix_chars, r.middle_chars) == plain("" if r.doc_id is None else r.doc_id, text)
        assert r.restored == text and r.restored_sha256 == sha(text) and r.output_sha256 == sha(r.output)
        assert (r.row, r.made) == ("r", "m")
    assert fim.restore(fim.transform(no_docs)).count() == 0
    assert fim.transform(odd_docs, keep=[]).columns == ["output", "n", "form", "prefix_chars", "middle_chars", "output_sha256"]


def test_long_text(spark):
    rows = [(k, "line é\n" * 500_000) for k in range(3)] + [(9, "x" * 5_000_000)]
    found = fim.restore(fim.transform(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [r.restored_sha256 for r in found.orderBy("doc_id").collect()] == [sha(t) for _, t in rows]
