"""Byte-level BPE encoding and decoding with batched numpy merge rounds.

A batch's distinct pieces stand as bytes in one flat symbol array.  In a round,
every adjacent pair within a piece is looked up by binary search over the sorted
pair keys; each piece merges all occurrences of its lowest-ranked pair; pieces
without a pair that merges are done.  Pieces that a worker has met are kept.

Pieces: the pattern of byte-level vocabularies, after the special tokens' strings
have been cut out (these become their ids).  A text is first cut before single
spaces that have no other white space next to them, where the pattern always ends
a piece, so that words can be kept with all their pieces.

A null text is empty: no ids.  Equal texts, and so repeated rows, have equal results.
A very long text is encoded part by part, cut where a piece ends anyway.  Of pairs of
equal rank in a piece all are merged, from the left where they overlap.  Columns that
are kept and named like an output column are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quire.llm.common import LONG_TEXT, map_texts

#: The pattern of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_WORDS = 500_000
#: Ids that are decoded at once.
RUN = 1 << 18

_CODECS: dict[str, Codec] = {}


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable
    bytes stand for themselves, the rest are numbered from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in set(plain))
    letters = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


class Codec:
    """Encodes and decodes as the vocabulary file's own library does, without
    truncation, padding or added special tokens."""

    def __init__(self, path: str, most: int = CACHE_WORDS):
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pre = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or pre["type"] != "ByteLevel" or not pre["use_regex"] or pre["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("not a plain byte-level BPE vocabulary")
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.symbol_of_byte = np.array([vocab[x] for x in letters], np.int64)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        byte_of = {x: b for b, x in enumerate(letters)}
        size = max([*vocab.values(), *self.special.values()]) + 1
        strings = [b""] * size
        for token, i in vocab.items():
            strings[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            strings[i] = token.encode()
        self.lengths = np.array([len(x) for x in strings], np.int64)
        self.places = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(strings), np.uint8)
        self.decimal = [str(i) for i in range(size)]
        self.pieces = regex.compile(PATTERN).findall
        self.safe = regex.compile(r"(?<=\S) (?=\S)")
        self.unsafe = regex.compile(r"\s | \s|^ | $").search
        self.cut = regex.compile("|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.most = most
        self.known: dict[str, bytes] = {}  # by piece
        self.first: dict[str, bytes] = {}  # by word at the start of a text
        self.later: dict[str, bytes] = {}  # by word after a space, without it

    def merge(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces as bytes of int32, by merge rounds over all of them."""
        raw = [p.encode() for p in pieces]
        lengths = np.array([len(x) for x in raw], np.int64)
        symbols = self.symbol_of_byte[np.frombuffer(b"".join(raw), np.uint8)]
        piece = np.repeat(np.arange(len(raw)), lengths)
        done_symbols, done_piece = [], []
        none = len(self.ranks)
        while len(symbols):
            keys = symbols[:-1] << 32 | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            rank = np.where((self.keys[at] == keys) & (piece[:-1] == piece[1:]), self.ranks[at], none)
            starts = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
            best = np.minimum.reduceat(np.append(rank, none), starts)
            sizes = np.diff(np.append(starts, len(symbols)))
            more = np.repeat(best < none, sizes)
            if not more.all():
                done_symbols.append(symbols[~more])
                done_piece.append(piece[~more])
                best_here = np.repeat(best, sizes)[more]
                symbols, piece, rank = symbols[more], piece[more], np.append(rank, none)[more]
            else:
                best_here, rank = np.repeat(best, sizes), np.append(rank, none)
            if not len(symbols):
                break
            hit = rank == best_here
            run = np.flatnonzero(hit)
            if len(run) > 1 and (np.diff(run) == 1).any():  # of touching ones, every other from the left
                begins = np.r_[True, np.diff(run) != 1]
                offset = np.arange(len(run)) - np.flatnonzero(begins)[np.cumsum(begins) - 1]
                run = run[offset % 2 == 0]
            symbols = symbols.copy()
            symbols[run] = self.merged[rank[run]]
            keep = np.ones(len(symbols), bool)
            keep[run + 1] = False
            symbols, piece = symbols[keep], piece[keep]
        if not done_piece:
            return [b""] * len(raw)
        piece, symbols = np.concatenate(done_piece), np.concatenate(done_symbols)
        order = np.argsort(piece, kind="stable")
        ids = symbols[order].astype("<i4").tobytes()
        ends = (4 * np.cumsum(np.bincount(piece, minlength=len(raw)))).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def learn(self, words: list[str]) -> list[bytes]:
        """Ids of words (whole runs between safe cuts), keeping their pieces."""
        split = [self.pieces(w) for w in words]
        new = {p for ps in split for p in ps}
        new.difference_update(self.known)
        if len(self.known) + len(new) > self.most:
            self.known = {}
            new = {p for ps in split for p in ps}
        new = list(new)
        self.known.update(zip(new, self.merge(new), strict=True))
        return [b"".join([self.known[p] for p in ps]) for ps in split]

    def spans(self, text: str) -> Iterator[str]:
        """A text in parts of about `LONG_TEXT` characters, cut at safe places."""
        at = 0
        while len(text) - at > LONG_TEXT:
            cut = self.safe.search(text, at + LONG_TEXT)
            if not cut:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:] if at else text

    def parts(self, text: str) -> Iterator[tuple[int, str]]:
        """(-1, text) for what is encoded by itself, (id, "") for special tokens."""
        at = 0
        for m in self.cut.finditer(text) if self.cut else ():
            yield from ((-1, x) for x in self.spans(text[at : m.start()]))
            yield self.special[m[0]], ""
            at = m.end()
        yield from ((-1, x) for x in self.spans(text[at:] if at else text))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Arrays of ids."""
        if any(len(x) > LONG_TEXT for x in texts):  # one at a time, and that in parts
            return [np.concatenate([self.encode_parts([[part]])[0] for part in self.parts(x)]) for x in texts]
        return self.encode_parts([list(self.parts(x)) for x in texts])

    def encode_parts(self, texts: list[list[tuple[int, str]]]) -> list[np.ndarray]:
        parts, sizes = [p for own in texts for p in own], [len(own) for own in texts]
        split = [(self.safe.split(t) if self.unsafe(t) else t.split(" ")) if t else [] for _, t in parts]
        if len(self.later) > self.most or len(self.first) > self.most:
            self.first, self.later = {}, {}
        new_first = {ws[0] for ws in split if ws} - self.first.keys()
        new_later: set[str] = set()
        for ws in split:
            new_later.update(ws[1:])
        new_later.difference_update(self.later)
        order_first, order_later = list(new_first), list(new_later)
        found = self.learn(order_first + [" " + w for w in order_later])
        self.first.update(zip(order_first, found[: len(order_first)], strict=True))
        self.later.update(zip(order_later, found[len(order_first) :], strict=True))
        first, later = self.first, self.later
        out, at = [], 0
        for n in sizes:
            raw = []
            for (special, _), ws in zip(parts[at : at + n], split[at : at + n], strict=True):
                if special >= 0:
                    raw.append(np.array([special], "<i4").tobytes())
                elif ws:
                    raw.append(first[ws[0]])
                    raw += [later[w] for w in ws[1:]]
            out.append(np.frombuffer(b"".join(raw), "<i4"))
            at += n
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of some ids, special tokens included; broken UTF-8 becomes U+FFFD."""
        return b"".join(map(self.raw, self.runs(ids))).decode("utf-8", "replace")

    @staticmethod
    def runs(ids: np.ndarray) -> Iterator[np.ndarray]:
        return (ids[at : at + RUN] for at in range(0, len(ids), RUN))

    def raw(self, ids: np.ndarray) -> bytes:
        """The bytes of some ids."""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        at = np.repeat(self.places[ids] - (ends - n), n) + np.arange(int(ends[-1]))
        return self.flat[at].tobytes()

    def digest(self, ids: np.ndarray) -> str:
        """SHA-256 of the decimal ids joined by commas."""
        out = hashlib.sha256()
        for k, run in enumerate(self.runs(ids)):
            out.update((("," if k else "") + ",".join(map(self.decimal.__getitem__, run.tolist()))).encode())
        return out.hexdigest()


def codec(path: str) -> Codec:
    """This worker's codec of a vocabulary file."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


IDS = T.StructType([T.StructField("token_ids", T.ArrayType(T.IntegerType(), False))])
ROUND_TRIP = T.StructType(
    [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
)


def encode_texts(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds token_ids, the ids of a text column."""

    def make():
        work = codec(path)
        return lambda raw, _: {"token_ids": work.encode([x.decode() for x in raw])}

    return map_texts(df, make, IDS, text, keep)


def decode_ids(df: DataFrame, path: str, ids: str = "token_ids", to: str = "decoded") -> DataFrame:
    """Adds the text of a column of ids; null ids give null."""
    import pyarrow as pa

    columns = [c for c in df.columns if c != to]
    schema = T.StructType([df.schema[c] for c in columns] + [T.StructField(to, T.StringType())])

    def run(batches):
        work = codec(path)
        for batch in batches:
            texts = [None if x is None else work.decode(np.array(x, np.int64)) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(texts, pa.string())], names=[*columns, to])

    return df.mapInArrow(run, schema)


def round_trip(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds n_tokens, ids_sha256 (decimal ids joined by commas) and decoded_sha256
    (the text decoded from those ids) in one pass; ids needn't leave the worker."""

    def make():
        codec_ = codec(path)

        def work(raw, _):
            out = {k: [] for k in ROUND_TRIP.names}
            for ids in codec_.encode([x.decode() for x in raw]):
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(codec_.digest(ids))
                out["decoded_sha256"].append(hashlib.sha256(codec_.decode(ids).encode()).hexdigest())
            return out

        return work

    return map_texts(df, make, ROUND_TRIP, text, keep)
