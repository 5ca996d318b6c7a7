"""op4, op5 and op9: ids, files and sequences."""

import hashlib
import os
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import bpe, common, packing, queries, token_files
from quire.llm.words import WordEncoder

os.environ["TOKENIZERS_PARALLELISM"] = "false"
WORD, BYTE = (queries.tokenizer_file(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def libraries():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD), Tokenizer.from_file(BYTE)


@pytest.fixture(scope="module")
def codecs():
    return WordEncoder(WORD), bpe.Codec(BYTE)


LETTERS = st.one_of(st.text(max_size=3), st.sampled_from([*"  \n\t'sdtmreAB.,!1", "é", "\u0331", "İ", "<|endoftext|>", "<|startoftext|>", "I'll", "Word"]))
TEXT = st.lists(LETTERS, max_size=12).map("".join)


@settings(deadline=None, max_examples=200)
@given(st.lists(TEXT, max_size=4))
def test_ids_are_the_librarys(libraries, codecs, texts):
    word, byte = libraries
    own, codec = codecs
    assert [np.frombuffer(x, "<u4").tolist() for x in own.ids([t.encode() for t in texts])] == [word.encode(t, add_special_tokens=False).ids for t in texts]
    ids = [byte.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in codec.encode(texts)] == ids
    assert [codec.decode(np.array(x, np.int64)) for x in ids] == [byte.decode(x, skip_special_tokens=False) for x in ids]


def test_odd_ids(libraries, codecs, odd_texts):
    word, byte = libraries
    texts = [t or "" for t in odd_texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in codecs[0].ids([t.encode() for t in texts])] == [word.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in codecs[1].encode(texts)] == [byte.encode(t, add_special_tokens=False).ids for t in texts]


def test_small_caches_change_nothing(libraries):
    small, codec = WordEncoder(WORD, most=6), bpe.Codec(BYTE, most=3)
    for text in ("a b c d e f g a b", "h i a b c! c, (c)", "a b c"):
        assert np.frombuffer(small.ids([text.encode()])[0], "<u4").tolist() == libraries[0].encode(text, add_special_tokens=False).ids
        assert codec.encode([text])[0].tolist() == libraries[1].encode(text, add_special_tokens=False).ids
    whole = WordEncoder(WORD, by_words=False)
    assert whole.ids([b"Hello  world"]) == small.ids([b"Hello  world"])


def test_long_texts_in_parts(libraries, monkeypatch, odd_texts):
    from quire.llm import words

    for module in (common, words, bpe):
        monkeypatch.setattr(module, "LONG_TEXT", 7)
    monkeypatch.setattr(bpe, "RUN", 3)
    own, codec = WordEncoder(WORD), bpe.Codec(BYTE)
    texts = [(t or "")[:400] for t in odd_texts] + ["one two  three\nfour <|endoftext|> five six.\tseven " * 3]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.ids([t.encode() for t in texts])] == [libraries[0].encode(t, add_special_tokens=False).ids for t in texts]
    ids = [libraries[1].encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in codec.encode(texts)] == ids
    assert [codec.decode(np.array(x, np.int64)) for x in ids] == [libraries[1].decode(x, skip_special_tokens=False) for x in ids]
    assert [codec.digest(np.array(x, np.int64)) for x in ids] == [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in ids]


def test_broken_bytes_decode_like_the_library(libraries, codecs):
    for ids in ([220, 447], [160, 100], [50256, 50256], []):
        assert codecs[1].decode(np.array(ids, np.int64)) == libraries[1].decode(ids, skip_special_tokens=False)


def test_bpe_query(spark, sf_dir, libraries):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op9_bpe_round_trip(spark, sf_dir).collect():
        ids = libraries[1].encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(libraries[1].decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_columns(odd_docs, odd_texts, no_docs):
    found = bpe.decode_ids(bpe.encode_texts(odd_docs, BYTE), BYTE).collect()
    assert [r.decoded for r in found] == [t or "" for t in [*odd_texts, odd_texts[8]]]
    assert "fp" in found[0].asDict()
    assert bpe.round_trip(no_docs, BYTE).count() == 0


IDS = st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_000), st.integers(0, 2**64 - 1), st.just(int(token_files.ESCAPE_WORD)), st.just(token_files.ESCAPE)), max_size=600)


@settings(deadline=None, max_examples=200)
@given(IDS, st.integers(0, 700), st.integers(0, 700))
def test_simple8b(ids, start, count):
    x = np.array(ids, np.uint64)
    assert token_files.decode(token_files.encode(x)).tolist() == ids
    block = token_files.pack_block([5, None], [len(ids) // 3, len(ids) - len(ids) // 3], x)
    docs, lengths, back = token_files.unpack_block(block)
    assert docs == [5, None] and lengths.sum() == len(ids) and back.tolist() == ids
    assert token_files.read_ids(block, min(start, len(ids)), count).tolist() == ids[min(start, len(ids)) :][:count]


def test_simple8b_packs_many_ids_a_word():
    assert len(token_files.encode(np.zeros(2400, np.uint64))) == 10
    assert len(token_files.encode(np.ones(600, np.uint64))) == 10
    assert len(token_files.encode(np.full(400, 30_000, np.uint64))) == 100


def test_broken_block():
    block = token_files.pack_block([1], [3], np.array([1, 2, 3], np.uint64))
    for bad in (b"XXXX" + block[4:], block + b"\0" * 8):
        with pytest.raises(ValueError, match="token block"):
            token_files.unpack_block(bad)


def test_token_query(spark, sf_dir, libraries):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op4_token_files(spark, sf_dir).collect()}
    before = 0
    for d in sorted(texts):
        ids = np.array([*libraries[0].encode(texts[d] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (before, len(ids), zlib.crc32(ids.tobytes()))
        before += len(ids)


def test_odd_token_files(spark, odd_docs, odd_texts, no_docs):
    found = token_files.read_token_files(spark, token_files.write_token_files(odd_docs, WORD, 2)).orderBy("start").collect()
    assert len(found) == len(odd_texts) + 1
    assert [r.doc_id for r in found] == sorted([r.doc_id for r in found], key=lambda d: (d is not None, d or 0))
    assert [r.start for r in found] == np.cumsum([0, *[r.n_tokens for r in found]])[:-1].tolist()
    assert token_files.read_token_files(spark, token_files.write_token_files(no_docs, WORD, 2)).count() == 0


def placed(counts, capacity):
    """Checks a plan and gives its sequences' fill."""
    places, used = packing.plan(counts, capacity)
    fill, ranks = [[] for _ in range(used)], {}
    for length, first, n, sequence, offset in places:
        ranks.setdefault(length, []).extend(range(first, first + n))
        for k in range(n):
            fill[sequence + k].append((offset, length))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(c)) for k, c in counts.items() if c}
    for own in fill:
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert 0 < at <= capacity
    return [sum(n for _, n in own) for own in fill]


def best_fit_decreasing(counts, capacity):
    """Sequences that the sequential method needs."""
    gaps = []
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
        gaps.append((min(fits) if fits else capacity) - n)
    return len(gaps)


@settings(deadline=None, max_examples=150)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 30), max_size=20))
def test_plans(counts):
    fill = placed(counts, 64)
    assert len(fill) <= 1.15 * best_fit_decreasing(counts, 64) + 1


def test_plan_is_tight():
    rng = np.random.default_rng(0)
    lengths = np.minimum(2048, rng.lognormal(6.3, 1.1, 20_000).astype(int) + 1)
    n, c = np.unique(lengths, return_counts=True)
    fill = placed(dict(zip(n.tolist(), c.tolist(), strict=True)), 2048)
    assert len(fill) <= 1.005 * -(-lengths.sum() // 2048)


def check_packing(rows, texts, library, capacity):
    """rows of one packing of {id: text} (ids unique)."""
    by_sequence = {}
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, {})[r.piece] = r
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for d, text in texts.items():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own = pieces.pop(d)
        assert sorted(own) == list(range(-(-len(ids) // capacity)))
        for k, r in own.items():
            part = ids[k * capacity : (k + 1) * capacity]
            assert (r.start, r.length, r.ids_crc32) == (k * capacity, len(part), zlib.crc32(part.tobytes()))
    assert not pieces
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *[r.length for r in own]])[:-1].tolist()
        assert sum(r.length for r in own) <= capacity


def test_packing_query(spark, sf_dir, libraries):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    check_packing(queries.op5_packing(spark, sf_dir).collect(), texts, libraries[0], 2048)


def test_odd_packing(odd_docs, odd_texts, no_docs):
    rows = packing.pack(odd_docs, WORD).collect()
    assert sum(r.piece == 0 for r in rows) == len(odd_texts) + 1
    assert max(sum(r.length for r in rows if r.sequence_id == s) for s in {r.sequence_id for r in rows}) <= 2048
    assert packing.pack(no_docs, WORD).count() == 0
