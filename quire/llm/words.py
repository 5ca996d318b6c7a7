"""Token ids of whole texts from a vocabulary file of the tokenizers library.

Where a tokenizer drops white space, the ids of a text are those of its words
one after another, so each distinct word is encoded once per worker and kept.
"""

from __future__ import annotations

import os
import string

import numpy as np

from quire.llm.common import LONG_TEXT, cuts

#: Words that a worker remembers at most, in two generations.
CACHE_WORDS = 1_600_000
#: Words that are encoded as one text.
CHUNK = 4000

PUNCTUATION = string.punctuation.encode()

_ENCODERS: dict[tuple[str, bool], WordEncoder] = {}


def alphabetic(word: bytes) -> bool:
    """Whether a word is letters alone, and stays so when lowered."""
    text = word.decode()
    return text.isalpha() and text.lower().isalpha()


class WordEncoder:
    """ids(texts) gives each text's ids as bytes of little-endian uint32.

    With `by_words` the tokenizer must drop white space (its pieces never reach
    over it), as `word_bpe_49k.json` does; texts are then cut at ASCII white
    space.  ASCII capitals are lowered first only where that can't matter: not
    near special tokens (`<|`) or combining marks (U+0300 to U+036F).

    Words of letters alone are one piece each, whose last token has the
    vocabulary's end-of-word suffix; many are encoded as one text and cut apart
    behind those tokens.
    """

    def __init__(self, path: str, by_words: bool = True, most: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.by_words, self.most = by_words, most
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        if suffix:
            self.ends[[i for token, i in vocab.items() if token.endswith(suffix)]] = True

    def encoded(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def encoded_letters(self, words: list[str]) -> list[bytes]:
        """Ids of words that are letters alone."""
        out: list[bytes] = []
        for at in range(0, len(words), CHUNK):
            chunk = words[at : at + CHUNK]
            ids = np.array(self.tokenizer.encode(" ".join(chunk), add_special_tokens=False).ids, "<u4")
            cuts = 4 * (np.flatnonzero(self.ends[ids]) + 1)
            if len(cuts) != len(chunk):
                out += self.encoded(chunk)
                continue
            raw, ends = ids.tobytes(), cuts.tolist()
            out += [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        return out

    def learn(self, words: set[bytes]) -> None:
        """Makes words known; beyond the limit, those not met for longest go."""
        if len(self.known) + len(words) > self.most // 2:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        letters: set[bytes] = set()
        marked, marks, others = [], set(), []
        for w in words:
            if w in older:
                known[w] = older[w]
                continue
            stem = w.rstrip(PUNCTUATION)
            if not (stem.isalpha() or alphabetic(stem)):
                others.append(w)
                continue
            if len(stem) < len(w):  # letters, then marks: two pieces
                marked.append((w, stem, mark := w[len(stem) :]))
                marks.add(mark)
            letters.add(stem)
        letters = list(letters.difference(known))
        known.update(zip(letters, self.encoded_letters([w.decode() for w in letters]), strict=True))
        others += marks.difference(known, others)
        if others:
            known.update(zip(others, self.encoded([w.decode() for w in others]), strict=True))
        known.update([(w, known[stem] + known[mark]) for w, stem, mark in marked])

    def forget(self) -> None:
        self.known, self.older = {}, {}

    def ids(self, texts: list[bytes]) -> list[bytes]:
        if not self.by_words:
            return self.encoded([x.decode() for x in texts])
        if any(len(x) > LONG_TEXT for x in texts):  # one at a time, and that in parts
            return [b"".join(self.word_ids([part])[0] for part in cuts(x)) for x in texts]
        return self.word_ids(texts)

    def word_ids(self, texts: list[bytes]) -> list[bytes]:
        found, new = [], set()
        get = self.known.get
        for x in texts:
            if b"<|" not in x and b"\xcc" not in x and b"\xcd" not in x:
                x = x.lower()
            words = x.split()
            ids = list(map(get, words))
            unseen = [k for k, i in enumerate(ids) if i is None] if None in ids else []
            new.update([words[k] for k in unseen])
            found.append((ids, unseen, [words[k] for k in unseen]))
        if new:
            self.learn(new)
        for ids, unseen, words in found:
            for k, w in zip(unseen, words, strict=True):
                ids[k] = self.known[w]
        return [b"".join(ids) for ids, _, _ in found]


def encoder(path: str, by_words: bool = True, most: int = CACHE_WORDS) -> WordEncoder:
    """This worker's encoder of a vocabulary file, remembering at most `most` words."""
    key = (path, by_words)
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(path, by_words, most)
    _ENCODERS[key].most = most
    return _ENCODERS[key]
