"""Language identification of mixed-language texts.

A word is a run without white space, lower-cased; its letters' Unicode ranges
give its script, and only languages that use the script in training are its
candidates.  A candidate's score is a naive Bayes sum over the word's byte
n-grams with word ends (2 to 5 bytes, hashed to `BUCKETS`).  Viterbi with a
penalty for switching then labels every word, so a text falls into spans.  The
predicted language is that of most letters, the score its share of them.

The n-gram tables are fitted on about `TRAIN_ROWS` texts of each language at
most, taken by a hash of the id (a documented bound of the classifier); rows with
crc32(id) mod 5 = 0 are never among them.  Every language is learned: the more
there are, the fewer buckets each has (`CELLS` in all, 256 each at least), and over
`MOST_LANGUAGES` values are refused as no languages.  Texts of any length are labelled in
bounded memory: the forward pass keeps its state every `STEP` words, and the way back
computes one such piece at a time again.

Nulls: a null text, or one without a letter, is `und` with score 0; so is every
text if nothing was learned.  A text with letters of unknown scripts alone gets
the most frequent language with score 0.  Null languages and null ids are not
learned from.  Repeated rows count as often as they occur.  Ties go to the language
first in order of names.  Input columns are kept, but for those named like an output
column.  An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import LONG_TEXT, binary, cuts, held_out, map_texts, slices, text_batches

TRAIN_ROWS = 5000
BUCKETS = 1 << 16
CELLS = 1 << 22
MOST_LANGUAGES = 32_767
#: Words between two states that the forward pass keeps.
STEP = 4096
#: Tasks that count the sample, each with a table per language.
FIT_TASKS = 16
ORDERS = (2, 3, 4, 5)
#: Cost of a change of language, and weight of an n-gram, in nats.
SWITCH = 12.0
WEIGHT = 0.5
#: Share of a language's words from which a script counts as its own.
SCRIPT_SHARE = 0.01
CACHE_WORDS = 200_000
#: Characters whose words are held as objects at once; as the words remembered, fewer from 128 languages on.
SPLIT_CHARS = 1 << 19
UNKNOWN = "und"

#: First code points of script ranges (the rest is "other").
SCRIPTS = [
    (0x0041, 0x024F, "latin"),
    (0x0370, 0x03FF, "greek"),
    (0x0400, 0x052F, "cyrillic"),
    (0x0530, 0x058F, "armenian"),
    (0x0590, 0x05FF, "hebrew"),
    (0x0600, 0x077F, "arabic"),
    (0x0900, 0x097F, "devanagari"),
    (0x0980, 0x09FF, "bengali"),
    (0x0B80, 0x0BFF, "tamil"),
    (0x0E00, 0x0E7F, "thai"),
    (0x10A0, 0x10FF, "georgian"),
    (0x1E00, 0x1EFF, "latin"),
    (0x3040, 0x30FF, "kana"),
    (0x3400, 0x9FFF, "han"),
    (0xAC00, 0xD7AF, "hangul"),
]
NAMES = sorted({name for *_, name in SCRIPTS} | {"other"})
LETTERS = re.compile(r"[^\W\d_]+")


def script(word: str) -> int:
    """Place in NAMES of the script of a word's first letter."""
    code = ord(word[0])
    return NAMES.index(next((name for a, b, name in SCRIPTS if a <= code <= b), "other"))


def buckets_of(languages: int) -> int:
    """Buckets of each of so many languages: a power of two."""
    if languages > MOST_LANGUAGES:
        raise ValueError(f"{languages} different languages")
    return max(256, min(BUCKETS, 1 << (CELLS // max(1, languages)).bit_length() - 1))


def ngrams(words: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(place of the word, bucket) of all n-grams; a word end counts as a space."""
    raw = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint64)
    space = raw == 32
    before = np.cumsum(space)
    owners, found = [], []
    for k in ORDERS:
        n = len(raw) - k + 1
        if n <= 0:
            continue
        h = np.full(n, k, np.uint64)
        for j in range(k):
            h = h * np.uint64(0x100000001B3) + raw[j : j + n] + np.uint64(1)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        inside = before[k - 2 : k - 2 + n] - before[:n] if k > 2 else np.zeros(n, np.int64)
        at = np.flatnonzero(inside == 0)
        owners.append(before[at] - 1)
        found.append((h[at] & np.uint64(buckets - 1)).astype(np.int64))
    return np.concatenate(owners), np.concatenate(found)


def letters_of(word: str) -> str:
    return "".join(LETTERS.findall(word))


@dataclass
class Model:
    languages: list[str]
    logs: np.ndarray  # languages x buckets
    scripts: np.ndarray  # languages x scripts, whether a language uses one
    first: int  # the most frequent language


def fit(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.where("doc_id is not null and lang is not null and text is not null").where(~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}  # one more is refused
    languages = sorted(sizes)
    buckets = buckets_of(len(languages))
    if not languages:
        return Model([], np.zeros((0, buckets), np.float32), np.zeros((0, len(NAMES)), bool), 0)
    place = {name: k for k, name in enumerate(languages)}
    taken = df.sparkSession.createDataFrame([(n, place[n], int((1 << 20) * min(1.0, TRAIN_ROWS / c)) + 1) for n, c in sizes.items()], "lang string, k int, below long")
    sample = rows.join(F.broadcast(taken), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.col("below")).select("k", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[int, np.ndarray] = {}
        scripts: dict[int, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                for k, raw in zip(part.column("k").to_pylist(), binary(part.column("text")), strict=True):
                    words = [w for w in map(letters_of, raw.decode().lower().split()) if w]
                    if not words:
                        continue
                    grams.setdefault(k, np.zeros(buckets, np.int64))
                    scripts.setdefault(k, np.zeros(len(NAMES), np.int64))
                    grams[k] += np.bincount(ngrams([w.encode() for w in words], buckets)[1], minlength=buckets)
                    scripts[k] += np.bincount([script(w) for w in words], minlength=len(NAMES))
        for kind, table in ((0, grams), (1, scripts)):
            for k, counts in table.items():
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), kind, np.int32)), pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(counts[at])],
                    names=["kind", "k", "bucket", "n"],
                )

    found = text_batches(sample.repartition(FIT_TASKS)).mapInArrow(count, "kind int, k int, bucket int, n long").groupBy("kind", "k", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(languages), buckets))
    used = np.zeros((len(languages), len(NAMES)))
    for kind, into in ((0, counts), (1, used)):
        own = found[found["kind"] == kind]
        into[own["k"].to_numpy(int), own["bucket"].to_numpy(int)] = own["n"].to_numpy(float)
    logs = np.log(counts + 0.5) - np.log(counts.sum(axis=1, keepdims=True) + 0.5 * buckets)
    share = used / np.maximum(1, used.sum(axis=1, keepdims=True))
    return Model(languages, logs.astype(np.float32), share >= SCRIPT_SHARE, place[max(sizes, key=lambda n: (sizes[n], n))])


class Labeller:
    """Labels the words of texts; remembers the words it has scored."""

    def __init__(self, model: Model):
        self.model = model
        share = max(1, len(model.languages) // 64)
        self.most, self.chars = max(1000, CACHE_WORDS // share), max(1000, SPLIT_CHARS // share)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.scores = np.zeros((1 << 12, len(self.model.languages)), np.float32)
        self.weights = np.zeros(1 << 12, np.int32)

    def learn(self, words: list[str]) -> None:
        model, at = self.model, len(self.known)
        end = at + len(words)
        while end > len(self.weights):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.weights = np.concatenate([self.weights, np.zeros_like(self.weights)])
        self.known.update(zip(words, range(at, end), strict=True))
        letters = [letters_of(w) for w in words]
        self.weights[at:end] = [len(x) for x in letters]
        self.scores[at:end] = 0
        some = [k for k, x in enumerate(letters) if x]
        if not some:
            return
        owner, bucket = ngrams([letters[k].encode() for k in some], model.logs.shape[1])
        scores = np.empty((len(some), len(model.languages)), np.float32)
        for k, logs in enumerate(model.logs):
            scores[:, k] = WEIGHT * np.bincount(owner, weights=logs[bucket], minlength=len(some))
        can = model.scripts[:, [script(letters[k]) for k in some]].T
        scores -= np.where(can, scores, -np.inf).max(axis=1, keepdims=True, initial=-1e30)
        scores = np.where(can, scores, np.float32(-50))
        scores[~can.any(axis=1)] = 0
        self.scores[at + np.array(some)] = scores
        self.weights[at + np.array(some)[~can.any(axis=1)]] = 0

    def words(self, texts: list[str]) -> list[np.ndarray]:
        """Places of each text's words, good until the next call."""
        if len(self.known) > self.most:
            self.clear()
        out, split, size = [], [], 0
        for x in texts:
            if len(x) > LONG_TEXT:
                parts = (part.decode() for part in cuts(x.encode()))
                out += self.places(split)
                split, size = [], 0
                out.append(np.concatenate([self.places([part.lower().split()])[0] for part in parts]))
                continue
            split.append(x.lower().split())
            size += len(x)
            if size >= self.chars:
                out += self.places(split)
                split, size = [], 0
        return out + self.places(split)

    def places(self, split: list[list[str]]) -> list[np.ndarray]:
        new = set()
        for words in split:
            new.update(words)
        new.difference_update(self.known)
        self.learn(list(new))
        get = self.known.__getitem__
        return [np.fromiter(map(get, words), np.int32, len(words)) for words in split]

    def viterbi(self, docs: list[np.ndarray]) -> list[np.ndarray]:
        """The language of every word: the best path of each text, all texts in step."""
        n_langs = len(self.model.languages)
        order = np.argsort([-len(d) for d in docs], kind="stable")
        lengths = np.array([len(docs[k]) for k in order])
        labels = [np.zeros(len(d), np.int16) for d in docs]
        if not len(docs) or not lengths[0] or n_langs < 2:
            return labels
        active = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")  # texts longer than t
        starts = np.cumsum(lengths) - lengths
        flat = np.concatenate([docs[k] for k in order])
        out = np.empty(len(flat), np.int16)
        own = np.arange(n_langs, dtype=np.int16)

        def step(v: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
            """The scores after word t of the texts that have one, and whence they come."""
            v = v[: active[t]]
            best, switch = v.argmax(axis=1).astype(np.int16), v.max(axis=1, keepdims=True) - np.float32(SWITCH)
            back = np.where(switch > v, best[:, None], own)
            return np.maximum(v, switch) + self.scores[flat[starts[: active[t]] + t]], back

        finals = np.zeros(len(docs), np.int16)
        states = []  # before words 1, 1 + STEP, ...
        v = self.scores[flat[starts[: active[0]]]]
        for t in range(1, lengths[0]):
            if (t - 1) % STEP == 0:
                states.append(v)
            m = active[t]
            if m < len(v):
                finals[m : len(v)] = v[m:].argmax(axis=1)
            v, _ = step(v, t)
        finals[: len(v)] = v.argmax(axis=1)
        state = finals
        for first in range(1 + (len(states) - 1) * STEP, 0, -STEP):
            v, backs = states.pop(), []
            last = min(first + STEP, lengths[0])
            for t in range(first, last):
                v, back = step(v, t)
                backs.append(back)
            for t in range(last - 1, first - 1, -1):
                m = active[t]
                out[starts[:m] + t] = state[:m]
                state[:m] = backs.pop()[np.arange(m), state[:m]]
        m = active[0]
        out[starts[:m]] = state[:m]
        for k, a, n in zip(order.tolist(), starts.tolist(), lengths.tolist(), strict=True):
            labels[k] = out[a : a + n]
        return labels


def spans(labels: np.ndarray, languages: list[str]) -> list[dict]:
    """Runs of one language: lang, first word, words."""
    if not len(labels):
        return []
    starts = np.flatnonzero(np.r_[True, labels[1:] != labels[:-1]])
    ends = np.append(starts[1:], len(labels))
    return [{"lang": languages[labels[a]], "first": int(a), "words": int(b - a)} for a, b in zip(starts, ends, strict=True)]


PREDICTED = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
SPANS = T.StructField("spans", T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("first", T.LongType()), T.StructField("words", T.LongType())])))


def predict(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, with_spans: bool = False) -> DataFrame:
    """Adds lang_pred and score, and on request the spans."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        labeller = Labeller(shared.value)
        languages = labeller.model.languages

        def work(raw: list[bytes], _) -> dict:
            texts = [x.decode() for x in raw]
            docs = labeller.words(texts) if languages else [np.zeros(0, np.int32) for _ in texts]
            out: dict[str, list] = {"lang_pred": [], "score": [], "spans": []}
            for x, places, labels in zip(texts, docs, labeller.viterbi(docs), strict=True):
                weights = labeller.weights[places]
                total = int(weights.sum())
                if total:
                    share = np.bincount(labels, weights=weights, minlength=len(languages))
                    best = int(share.argmax())
                    found = languages[best], float(share[best] / total)
                elif languages and any(c.isalpha() for c in x):
                    found = languages[labeller.model.first], 0.0
                else:
                    found = UNKNOWN, 0.0
                out["lang_pred"].append(found[0])
                out["score"].append(found[1])
                if with_spans:
                    out["spans"].append(spans(labels, languages) if found[0] != UNKNOWN else [])
            return out

        return work

    added = T.StructType([*PREDICTED.fields, *([SPANS] if with_spans else [])])
    return map_texts(df, make, added, text, keep, most=(8 << 20) // max(1, len(model.languages) // 8))
