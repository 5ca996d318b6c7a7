import zlib

import numpy as np
import pytest

from quire.llm import langid, queries

SYLLABLES = {"xx": ["ka", "to", "mi", "sun", "rel"], "yy": ["schl", "og", "ung", "ber", "heit"], "zz": ["при", "вет", "мир", "дом", "лес"]}


def word(rng, lang):
    return "".join(rng.choice(SYLLABLES[lang], rng.integers(1, 4)))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(5)
    rows = []
    for d in range(400):
        lang = ("xx", "yy", "zz")[d % 3]
        rows.append((d, " ".join(word(rng, lang) for _ in range(rng.integers(5, 60))), lang if d % 7 else None))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


@pytest.fixture(scope="module")
def model(corpus):
    return langid.fit(corpus)


def test_held_out_accuracy(corpus, model):
    assert model.languages == ["xx", "yy", "zz"]
    got = langid.predict(corpus, model, keep=["doc_id", "lang"]).collect()
    rows = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.lang]
    assert len(rows) > 40 and all(r.lang == r.lang_pred for r in rows)
    assert all(0 <= r.score <= 1 for r in got)


def plain_viterbi(scores, switch):
    paths = {k: (s, [k]) for k, s in enumerate(scores[0])}
    for row in scores[1:]:
        paths = {k: max(((v - switch * (j != k) + row[k], [*p, k]) for j, (v, p) in paths.items()), key=lambda x: x[0]) for k in paths}
    return max(v for v, _ in paths.values()), paths


def test_paths_are_the_best(model):
    rng = np.random.default_rng(1)
    labeller = langid.Labeller(model)
    texts = [" ".join(word(rng, str(rng.choice(["xx", "yy", "zz"]))) for _ in range(n)) for n in (0, 1, 2, 9, 30, 7, 30)]
    docs = labeller.words(texts)
    for places, labels in zip(docs, labeller.viterbi(docs), strict=True):
        assert len(labels) == len(places)
        if not len(places):
            continue
        scores = labeller.scores[places].astype(float)
        own = scores[np.arange(len(places)), labels].sum() - langid.SWITCH * (labels[1:] != labels[:-1]).sum()
        assert abs(own - plain_viterbi(scores.tolist(), langid.SWITCH)[0]) < 1e-3


def test_long_texts_in_parts(model, monkeypatch, odd_texts):
    from quire.llm import common

    texts = [(t or "")[:300] for t in odd_texts]
    whole = langid.Labeller(model)
    want = [whole.scores[p] for p in whole.words(texts)]
    for module in (common, langid):
        monkeypatch.setattr(module, "LONG_TEXT", 6)
    parts = langid.Labeller(model)
    got = [parts.scores[p] for p in parts.words(texts)]
    # white space beyond ASCII may end a part's last word, never split one
    assert all(np.allclose(a, b) for a, b in zip(want, got, strict=True))


def test_spans_of_mixed_text(spark, model):
    rng = np.random.default_rng(2)
    text = " ".join([word(rng, "xx") for _ in range(40)] + [word(rng, "yy") for _ in range(25)] + [word(rng, "zz") for _ in range(10)])
    row = langid.predict(spark.createDataFrame([(text,)], "text string"), model, with_spans=True).first()
    assert [(s.lang, s.words) for s in row.spans] == [("xx", 40), ("yy", 25), ("zz", 10)]
    assert row.lang_pred in ("xx", "yy") and 0.2 < row.score < 0.8


def test_ngrams_stay_in_their_words():
    owner, bucket = langid.ngrams([b"ab", b"c"])
    alone = [langid.ngrams([w])[1].tolist() for w in (b"ab", b"c")]
    assert sorted(bucket[owner == 0].tolist()) == sorted(alone[0]) and sorted(bucket[owner == 1].tolist()) == sorted(alone[1])
    assert len(alone[0]) == 3 + 2 + 1 and len(alone[1]) == 2 + 1


def test_scripts_narrow_candidates(spark, model):
    got = langid.predict(spark.createDataFrame([("мир",), ("ka",), ("日本",), ("ka 日本 日本日本日本",)], "text string"), model).collect()
    assert got[0].lang_pred == "zz" and got[1].lang_pred != "zz" and (got[2].lang_pred in model.languages and got[2].score == 0) and got[3].score == 1


def test_odd_documents(odd_docs, odd_texts, no_docs, model):
    got = langid.predict(odd_docs, model, with_spans=True).collect()
    assert len(got) == len(odd_texts) + 1
    for r in got:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
    assert langid.predict(no_docs, langid.fit(no_docs)).count() == 0
    assert {r.lang_pred for r in langid.predict(odd_docs, langid.fit(no_docs)).collect()} == {"und"}
    assert langid.fit(odd_docs).languages == ["en"]
    assert {r.lang_pred for r in langid.predict(odd_docs, langid.fit(odd_docs)).collect()} == {"en", "und"}


def test_query(spark, sf_dir):
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.op8_language(spark, sf_dir).collect()
    assert len(got) == len(docs)
    rows = [r for r in got if r.held_out and docs[r.doc_id]]
    assert np.mean([r.lang_pred == docs[r.doc_id] for r in rows]) > 0.95


def plain_buckets(word):
    """The n-gram buckets of a word's bytes between two spaces, in plain Python."""
    raw, found = b" " + word.encode() + b" ", []
    for k in langid.ORDERS:
        for at in range(len(raw) - k + 1):
            h = k
            for b in raw[at : at + k]:
                h = (h * 0x100000001B3 + b + 1) % 2**64
            h = (h ^ h >> 29) * 0xBF58476D1CE4E5B9 % 2**64
            found.append((h ^ h >> 32) % langid.BUCKETS)
    return found


def test_tables_scores_and_predictions_are_those_of_a_plain_version(corpus, model):
    rows = [(d, t, lang) for d, t, lang in corpus.collect() if lang and zlib.crc32(str(d).encode()) % 5]
    counts = {lang: np.zeros(langid.BUCKETS) for lang in SYLLABLES}
    for _, text, lang in rows:
        for w in text.lower().split():
            np.add.at(counts[lang], plain_buckets(w), 1)
    logs = {lang: np.log(c + 0.5) - np.log(c.sum() + 0.5 * langid.BUCKETS) for lang, c in counts.items()}
    for k, lang in enumerate(model.languages):
        assert np.allclose(model.logs[k], logs[lang], atol=1e-4)
        used = {langid.NAMES[j] for j in np.flatnonzero(model.scripts[k])}
        assert used == ({"cyrillic"} if lang == "zz" else {"latin"})
    texts = {d: t for d, t, _ in corpus.collect()}
    for r in langid.predict(corpus, model, keep=["doc_id"]).limit(60).collect():
        words, scores = texts[r.doc_id].lower().split(), []
        for w in words:
            can = ["zz"] if w[0] > "z" else ["xx", "yy"]
            own = {lang: langid.WEIGHT * logs[lang][plain_buckets(w)].sum() for lang in can}
            scores.append([own[lang] - max(own.values()) if lang in own else -50.0 for lang in model.languages])
        value, paths = plain_viterbi(scores, langid.SWITCH)
        path = next(p for v, p in paths.values() if v == value)
        share = [sum(len(w) for w, k in zip(words, path, strict=True) if k == j) for j in range(3)]
        assert r.lang_pred == model.languages[int(np.argmax(share))] and abs(r.score - max(share) / sum(share)) < 1e-9


def test_no_language_is_dropped(spark):
    rows = [(d, " ".join(f"{chr(97 + d % 26)}{chr(97 + d // 26 % 26)}{c}q" for c in "abcdefgh"), f"l{d % 300:03}") for d in range(1500)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 300 and model.logs.shape == (300, 8192)
    with pytest.raises(ValueError):
        langid.buckets_of(langid.MOST_LANGUAGES + 1)


def test_paths_do_not_depend_on_the_pieces(model, monkeypatch):
    rng = np.random.default_rng(3)
    texts = [" ".join(word(rng, str(rng.choice(["xx", "yy", "zz"]))) for _ in range(n)) for n in (0, 1, 2, 3, 40, 8, 9, 23)]
    labeller = langid.Labeller(model)
    docs = labeller.words(texts)
    whole = labeller.viterbi(docs)
    for step in (1, 2, 7):
        monkeypatch.setattr(langid, "STEP", step)
        assert all((a == b).all() for a, b in zip(whole, labeller.viterbi(docs), strict=True))


def test_long_texts_take_little_memory():
    import tracemalloc

    rng = np.random.default_rng(4)
    model = langid.Model([f"l{k:03}" for k in range(100)], rng.normal(size=(100, 1024)).astype(np.float32), np.ones((100, len(langid.NAMES)), bool), 0)
    labeller = langid.Labeller(model)
    text = " ".join(f"w{k % 2000}" for k in range(50_000))
    tracemalloc.start()
    docs = labeller.words([text])
    labels = labeller.viterbi(docs)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(labels[0]) == 50_000 and most < 20_000_000  # scores and back pointers of all words would take 30 MB
