import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import queries, toxicity

WORDS = [f"w{k}" for k in range(300)]
BAD = ["rotten", "vile", "foul"]


def held(d):
    return zlib.crc32(str(d).encode()) % 5 == 0


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(3)
    docs, labels = [], []
    for d in range(1200):
        words = rng.choice(WORDS, rng.integers(20, 120)).tolist()
        toxic = int(rng.random() < 0.25)
        if toxic:
            for _ in range(rng.integers(2, 6)):
                words.insert(int(rng.integers(0, len(words))), str(rng.choice(BAD)) + str(rng.choice(["", "!", ","])))
        docs.append((d, " ".join(words)))
        if d % 3:
            labels.append((d, toxic))
    docs_df = spark.createDataFrame(docs, "doc_id long, text string")
    return docs_df, spark.createDataFrame(labels, "doc_id long, toxic int"), dict(docs), dict(labels)


def test_separates_held_out_rows(corpus):
    docs, labels, _, truth = corpus
    got = toxicity.score(docs, toxicity.fit(docs, labels), keep=["doc_id"]).collect()
    rows = [r for r in got if held(r.doc_id) and r.doc_id in truth]
    assert len(rows) > 100
    assert np.mean([r.predicted == truth[r.doc_id] for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_held_out_labels_change_nothing(corpus):
    docs, labels, _, _ = corpus
    other = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = toxicity.score(docs, toxicity.fit(docs, labels), keep=["doc_id"]).orderBy("doc_id").collect()
    b = toxicity.score(docs, toxicity.fit(docs, other), keep=["doc_id"]).orderBy("doc_id").collect()
    assert a == b


def plain_tokens(text):
    return [w for w in (x.strip(toxicity.MARKS.decode()) for x in (text or "").lower().split()) if w]


def plain_evidence(texts, labels, asked, share):
    """The model of the docstring, in plain Python: evidence of each asked text."""
    follows, pairs, words = {}, ({}, {}), ({}, {})
    for k, text in enumerate(texts):
        own = plain_tokens(text)
        for v, w in zip(["", *own], own, strict=False):
            follows.setdefault(w, set()).add(v)
        if labels[k] is not None:
            for p in set(zip(["", *own], own, strict=False)):
                pairs[labels[k]][p] = pairs[labels[k]].get(p, 0) + 1
            for w in set(own):
                words[labels[k]][w] = words[labels[k]].get(w, 0) + 1
    spread = sum(map(len, follows.values()))

    def less(n, discounts):
        return discounts[min(n, 3) - 1] if n else 0.0

    def word(c, w):
        total = sum(words[c].values())
        free = sum(less(n, toxicity.WORDS) for n in words[c].values()) / total
        n = words[c].get(w, 0)
        return (n - less(n, toxicity.WORDS)) / total + free * len(follows[w]) / spread

    def pair(c, v, w):
        own = {p: n for p, n in pairs[c].items() if p[0] == v}
        total = sum(own.values())
        if not total:
            return word(c, w)
        n = own.get((v, w), 0)
        return (n - less(n, toxicity.PAIRS)) / total + sum(less(n, toxicity.PAIRS) for n in own.values()) / total * word(c, w)

    found = []
    for text in asked:
        own = plain_tokens(text)
        events = set(zip(["", *own], own, strict=False))
        found.append(sum(math.log((1 - share) + share * pair(1, v, w) / pair(0, v, w)) for v, w in events) / max(1, len(events)))
    return found


@pytest.mark.parametrize("most", [toxicity.GATHERED, 40])
def test_evidence_is_that_of_the_plain_model(spark, monkeypatch, most):
    monkeypatch.setattr(toxicity, "GATHERED", most)
    rng = np.random.default_rng(5)
    names = ["the", "of", "a", "vile", "Rotten!", "w1", "w2", "w3", "w4", "w5", "-", "x,"]
    share = np.r_[[0.25, 0.15, 0.1], np.full(9, 0.5 / 9)]
    texts, labels = [], []
    for k in range(90):
        texts.append(" ".join(rng.choice(names, rng.integers(0, 25), p=share)) + (" the vile rotten" if k % 3 == 0 else ""))
        labels.append([1, 0, 0, None][k % 4])
    texts += ["", None, "  ", "new words of the kind"]
    labels += [1, 0, None, None]
    df = spark.createDataFrame([(k, t, y) for k, (t, y) in enumerate(zip(texts, labels, strict=True))], "k long, text string, label int").repartition(3)
    words, leads, pairs, base = toxicity.tables(toxicity.counts(df))
    assert pairs.count() and leads.count()
    model = toxicity.Model(words, leads, pairs, base, 0.1, (0.0, 0.0, 0.0))
    want = plain_evidence(texts, labels, texts, 0.1)
    for limit in (10**6, 0):  # broadcast, joined
        monkeypatch.setattr(toxicity, "BROADCAST_WORDS", limit)
        got = {r.k: (r["__evidence_0"], r["__length"]) for r in toxicity.evidences(df, model, "text", ["k"], (0.1,)).collect()}
        assert max(abs(got[k][0] - e) for k, e in enumerate(want)) < 1e-9
        assert got[len(texts) - 3] == (0.0, 0) and got[len(texts) - 4] == (0.0, 0)


def test_join_equals_broadcast(corpus, monkeypatch):
    docs, labels, _, _ = corpus
    model = toxicity.fit(docs, labels)
    both = []
    for limit in (10**6, 0):
        monkeypatch.setattr(toxicity, "BROADCAST_WORDS", limit)
        both.append([(r.doc_id, round(r.score, 9)) for r in toxicity.score(docs, model, keep=["doc_id"]).orderBy("doc_id").collect()])
    assert both[0] == both[1]


def test_logistic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 2))
    y = (rng.random(4000) < 1 / (1 + np.exp(-(0.5 + 2 * x[:, 0] - x[:, 1])))).astype(float)
    assert np.abs(np.array(toxicity.logistic(x, y)) - [0.5, 2, -1]).max() < 0.2


def test_odd_documents(spark, odd_docs, odd_texts, no_docs):
    labels = spark.createDataFrame([(k, k % 2) for k in range(12)] + [(1, 0), (None, 1), (3, None), (99, 1)], "doc_id long, toxic int")
    for docs, n in ((odd_docs, len(odd_texts) + 1), (no_docs, 0)):
        got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
        assert len(got) == n
        assert all(r.score is not None and r.fp == "fp" or r.fp == "x" for r in got)
    none = toxicity.fit(odd_docs, labels.limit(0))
    assert {r.score for r in toxicity.score(odd_docs, none).collect()} == {0.5}


def test_query(spark, sf_dir):
    got = queries.op3_toxicity(spark, sf_dir).collect()
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r.held_out == held(r.doc_id) for r in got)


def test_continuation_counts_grow_with_the_input(spark):
    df = spark.createDataFrame([(f"p{k} the p{k % 40} of", k % 2) for k in range(3000)], "text string, label int").repartition(3)
    follows = [round(r.follows) for r in toxicity.counts(df).where("kind = 0").orderBy(F.desc("follows")).limit(2).collect()]
    assert follows == [3000, 40]  # the, of


def test_few_toxic_labels(corpus):
    docs, _, texts, truth = corpus
    folds = {d: zlib.crc32(str(d).encode()) % 5 for d in truth}
    for allowed in ((2, 3), (3,)):  # toxic labels in two folds, or in one alone
        labels = [(d, t) for d, t in truth.items() if not t or folds[d] in allowed]
        model = toxicity.fit(docs, docs.sparkSession.createDataFrame(labels, "doc_id long, toxic int"))
        got = {r.doc_id: r.predicted for r in toxicity.score(docs, model, keep=["doc_id"]).collect()}
        assert model.informed
        assert np.mean([got[d] for d, t in truth.items() if t]) > 0.8 and np.mean([got[d] for d, t in truth.items() if not t]) < 0.05


def test_stage_keeps_documents_without_evidence(corpus, tmp_path):
    import corpus_pipeline

    docs, _, _, truth = corpus
    for name, labels in (("none", []), ("toxic", [(d, 1) for d, t in truth.items() if t]), ("clean", [(d, 0) for d, t in truth.items() if not t])):
        docs.sparkSession.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        assert corpus_pipeline.drop_toxic(docs.sparkSession, docs, f"{tmp_path}/{name}").count() == docs.count()


def test_a_task_sends_a_pair_once():
    """A row has five to six bytes for a pair of words, not the pair twice with wide counts."""
    rng = np.random.default_rng(1)
    now = toxicity.Gathered(64)
    pairs = set()
    for k in range(400):
        words = [f"w{x}".encode() for x in rng.integers(0, 400, 200)]
        now.add(words, (0, 0, 1, None)[k % 4])
        pairs |= set(zip([b"", *words], words, strict=False))
    sent = sum(len(x) for column in now.rows().to_pydict().values() for x in column if isinstance(x, bytes))
    assert len(pairs) > 50_000 and sent < 6.5 * len(pairs)


def test_counts_of_any_width():
    for n in (0, 1, 255, 256, 70_000):
        assert toxicity.widened(toxicity.narrowed(np.array([n, 0, 1])), 3).tolist() == [n, 0, 1]
    assert toxicity.widened(toxicity.narrowed(np.zeros(0, np.uint32)), 0).tolist() == []
