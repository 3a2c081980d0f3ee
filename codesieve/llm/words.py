"""Ids of a word-level BPE tokenizer, with a memory of the words seen.

The tokenizer drops white space, lower-cases, and never merges across white space or from a letter to
another sign, so the ids of a text are those of its lower-cased words in a row.  Words are given to the
tokenizers library the first time they are seen.
"""

from __future__ import annotations

import json
import os
import string
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Texts with these go to the library whole: str.split() cuts at the first four, the
# tokenizer does not; the last two are lower-cased in another way by str.lower().
_APART = tuple(map(chr, (0x1C, 0x1D, 0x1E, 0x1F, 0x130, 0x3A3)))


# Characters of the texts that are looked up together: they hold few arrays, so there may be more of them.
WORD_GROUP = 1_000_000


class Words:
    """``encode`` gives the ids of texts as bytes of ``kind``: little-endian unsigned integers of
    16 bits if all ids fit, else of 32 bits.

    ``remember`` bounds the words kept, twice: when so many are known, they become the older
    ones, of which those that come again are kept.  Words of over 64 characters are never kept.
    """

    def __init__(self, path: str, remember: int = 450_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        setup = json.loads(self.library.to_str())
        split = [p for p in (setup["pre_tokenizer"] or {}).get("pretokenizers", []) if p["type"] == "Split"]
        lower = "Lowercase" in [n["type"] for n in (setup["normalizer"] or {}).get("normalizers", [])]
        # Only such a tokenizer may be fed word by word.
        self.by_word = bool(split) and split[0]["behavior"] == "Removed" and split[0]["invert"] and lower
        ends = setup["model"].get("end_of_word_suffix")
        vocab = self.library.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.kind = "<u2" if len(self.last) <= 1 << 16 else "<u4"
        if ends:
            self.last[[i for token, i in vocab.items() if token.endswith(ends)]] = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.remember = remember

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters only: each is one run of merges, whose last id ends a word."""
        ids = np.array(self.library.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, self.kind)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words):
            return self._ids(words)
        raw, at = ids.tobytes(), [0, *(ids.itemsize * ends).tolist()]
        return [raw[a:b] for a, b in zip(at, at[1:])]

    def _learn(self, words: list[str]) -> None:
        known, letters, stems, others = self.known, [], [], []
        for w in words:
            if w.isalpha():
                letters.append(w)
            elif (stem := w.rstrip(string.punctuation)).isalpha():
                stems.append((w, stem))  # signs after the last letter are one run of their own
            else:
                others.append(w)
        marks = list({w[len(stem):] for w, stem in stems})
        marks = dict(zip(marks, self._ids(marks)))
        fresh = {stem for _, stem in stems if stem not in known}
        fresh.update(letters)
        if fresh:
            fresh = list(fresh)
            known.update(zip(fresh, self._letters(fresh)))
        known.update([(w, known[stem] + marks[w[len(stem):]]) for w, stem in stems])
        if others:
            known.update(zip(others, self._ids(others)))

    def _known(self, words: list[str]) -> list[bytes]:
        """Ids of different words, from memory where they are there."""
        if len(self.known) >= self.remember:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        out = list(map(known.get, words))
        missing = [i for i, ids in enumerate(out) if ids is None]
        new = []
        for i in missing:
            if (w := words[i]) in older:
                known[w] = older[w]
            else:
                new.append(w)
        self._learn(new)
        for i in missing:
            out[i] = known[words[i]]
        for w in new:
            if len(w) > 64:
                del known[w]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return self._ids(texts)
        lower = [t.lower() for t in texts]
        apart = [i for i, t in enumerate(texts) if not t.isascii() and not is_normalized("NFC", t) or any(c in t for c in _APART)]
        for i in apart:
            lower[i] = ""
        # Each different word is looked up once; its ids are then copied to all its places.
        split = pc.utf8_split_whitespace(pa.array(lower, pa.large_string()))
        words = split.flatten().dictionary_encode()
        ids = self._known(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        flat = np.frombuffer(b"".join(ids), self.kind)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // flat.itemsize
        first, at = np.cumsum(size) - size, words.indices.to_numpy()
        n = size[at]
        ends = np.cumsum(n)
        raw = flat[np.repeat(first[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        cuts = (np.concatenate(([0], ends))[split.offsets.to_numpy()] * flat.itemsize).tolist()
        out = [raw[a:b] for a, b in zip(cuts, cuts[1:])]
        if apart:
            for i, ids in zip(apart, self._ids([texts[i] for i in apart])):
                out[i] = ids
        return out

    def wide(self, ids: bytes) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return np.frombuffer(ids, self.kind).astype("<u4").tobytes()


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Words:
    return Words(path)
