"""Decontamination against a word-by-word search, in one automaton and in many."""

import random
import re

import pytest

from quire.llm import contamination
from quire.llm.common import LONG_TEXT

WORD = re.compile("[^\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain(text, items, size=10):
    """(words, hit words, items, spans) of a text; items are (id, text)."""
    found = list(WORD.finditer(lowered(text)))
    words, hit, named = [m[0] for m in found], set(), set()
    for item, own in items:
        own = WORD.findall(lowered(own))
        n = min(len(own), size)
        grams = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if own else set()
        for k in range(len(words) - n + 1):
            if tuple(words[k : k + n]) in grams:
                hit.update(range(k, k + n))
                named.add(item)
    spans = []
    for k in sorted(hit):
        if k - 1 in hit:
            spans[-1][1] = found[k].end()
        else:
            spans.append([found[k].start(), found[k].end()])
    return len(words), len(hit), sorted(i for i in named if i is not None), [tuple(s) for s in spans]


@pytest.fixture(scope="module")
def planted():
    pick = random.Random(5)
    vocabulary = ["alpha", "Beta", "γάμμα", "delta7", "E", "zed", "日本", "42"]
    say = lambda n: " ".join(pick.choice(vocabulary) + pick.choice(["", "", ",", "!?", "\n", "_"]) for _ in range(n))
    items = [(k, say(pick.choice([1, 3, 9, 10, 11, 40]) if k else 40)) for k in range(14)]
    items += [(3, "another text of item three here"), (None, "words of no item at all"), (20, None), (21, "?!"), (22, "")]
    docs = [(k, say(pick.randrange(0, 60))) for k in range(60)]
    docs += [(100 + k, f"{say(5)} {(text or '').upper()} {say(5)}") for k, (_, text) in enumerate(items)]
    docs += [(None, None), (7, ""), (7, items[0][1]), (7, items[0][1]), (8, "WORDS-OF/no item.AT all"), (9, "words_of no items at all")]
    return docs, items


def found(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS items", "'s' AS spans", "'f' AS found", "'b' AS body", "'r' AS row")
    i = spark.createDataFrame(items, "item_id long, text string")
    out = contamination.scan(d, i, **options)
    assert out.columns == ["doc_id", "text", "found", "body", "row", "n_words", "n_hit", "items", "spans"]
    rows = out.collect()
    assert all((r.found, r.body, r.row) == ("f", "b", "r") for r in rows)
    return sorted(((r.doc_id, r.text, r.n_words, r.n_hit, list(r["items"]), [tuple(s) for s in r.spans]) for r in rows), key=repr)


@pytest.mark.parametrize("block_bytes", [contamination.BLOCK_BYTES, 3000])
def test_equals_plain_search(spark, planted, block_bytes):
    docs, items = planted
    want = sorted(((d, t, *plain(t, items)) for d, t in docs), key=repr)
    assert found(spark, docs, items, block_bytes=block_bytes) == want
    assert any(w[3] for w in want) and not all(w[3] for w in want)


def test_empty_tables(spark, planted):
    docs, items = planted
    assert found(spark, docs[:0], items) == []
    assert all(row[3:] == (0, [], []) for row in found(spark, docs, items[:0]))
    assert all(row[3:] == (0, [], []) for row in found(spark, docs, [(1, None), (2, "...")]))


def test_spans_without_places(spark, planted):
    docs, items = planted
    got = found(spark, [(1, f"x y {items[0][1]} z")], items[:1], locate=False)
    assert got[0][5] == [(2, 41)]


def test_occurrence_over_parts_of_a_long_text(spark):
    item = "one two three four five six seven eight nine ten eleven"
    filler = "w " * (LONG_TEXT // 2 - 12)  # the first part ends within the item
    text = f"{filler}{item.upper()} {filler}{item} end"
    n, hit, items, spans = plain(text, [(1, item)])
    assert hit == 22 and len(spans) == 2
    assert found(spark, [(5, text)], [(1, item)]) == [(5, text, n, hit, items, spans)]


def test_common_window(spark):
    """One passage in a third of all texts and in every item."""
    passage = " ".join(f"p{k}" for k in range(12))
    items = [(k, f"{passage} tail{k}") for k in range(200)]
    docs = [(k, f"head{k} {passage}" if k % 3 == 0 else f"nothing {k}") for k in range(900)]
    got = found(spark, docs, items)
    assert sum(len(r[4]) == 200 for r in got) == 300 and sum(r[3] == 0 for r in got) == 600
