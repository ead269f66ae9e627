"""Token ids by the tokenizers library, with a bounded memory of words that recur.

For vocabularies that drop white space and mark word ends: the ids of a text are the ids of its words in a row, and the
ids of a word those of its pre-tokens, each of which ends with an id that carries the end mark.  New pre-tokens go
through the library many at a time and its answer is cut at the end marks.  Words outside plain Latin letters, digits
and signs go through the library one by one, and texts with separators that Python and the library split differently
go through it whole.  For plain texts the normaliser only lowers letters, as ``str.lower`` does.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from itertools import groupby

import numpy as np

#: Entries of a worker's memory before it starts afresh.
REMEMBERED = 600_000
#: Longer words are encoded each time, so that the memory stays bounded in bytes.
LONGEST_REMEMBERED = 64
#: str.split() takes these for white space; the library's pattern does not.
_ODD_SEPARATORS = re.compile("[\x1c-\x1f]")
#: Characters whose classes and small letters no Unicode version changes, and white space.
_PLAIN = re.compile("[\t-\r \x21-\x7e\xa1-\u012f\u0131-\u024f]*")


class WordEncoder:
    """Little-endian unsigned 32-bit ids of whole texts."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.bare = Tokenizer.from_str(json.dumps(spec | {"normalizer": None}))
        suffix = spec["model"]["end_of_word_suffix"]
        self.cut = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.is_end = np.zeros(self.library.get_vocab_size(), dtype=bool)
        self.is_end[[i for token, i in spec["model"]["vocab"].items() if token.endswith(suffix)]] = True
        self.known: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _pieces(self, new: list[str]) -> dict[str, bytes]:
        """Ids of pre-tokens by the library, many in one call."""
        out: dict[str, bytes] = {}
        for i in range(0, len(new), 512):
            some = new[i : i + 512]
            ids = np.asarray(self.bare.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = (np.flatnonzero(self.is_end[ids]) + 1).tolist()
            if len(ends) != len(some):
                raise ValueError("the vocabulary does not end each pre-token with an end mark")
            data = ids.tobytes()
            out.update((w, data[4 * a : 4 * b]) for w, a, b in zip(some, [0, *ends], ends))
        return out

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of plain words in small letters."""
        cut = {w: self.cut(w) for w in words if not w.isalpha()}
        parts = {p for ps in cut.values() for p in ps}
        out = self._pieces(list(parts.union(words.difference(cut)).difference(self.known)))
        for w, ps in cut.items():
            out[w] = b"".join([out[p] if p in out else self.known[p] for p in ps])
        return out

    def encode(self, text: str) -> bytes:
        if "<|" in text or not _PLAIN.fullmatch(text):
            return self._mixed(text)
        words = text.lower().split()
        known = self.known
        new = set(words).difference(known)
        if new:
            learned = self._learn(new)
            known.update(learned)
        data = b"".join(map(known.__getitem__, words))
        if new:
            for w in [w for w in learned if len(w) > LONGEST_REMEMBERED]:
                del known[w]
            if len(known) > REMEMBERED:
                known.clear()
        return data

    def _mixed(self, text: str) -> bytes:
        if _ODD_SEPARATORS.search(text):
            return self._whole(text)
        words = text.split()
        plain = " ".join([w for w in words if "<|" not in w and _PLAIN.fullmatch(w)])
        if len(plain) < len(text) // 2:
            return self._whole(text)
        out = []
        for is_plain, run in groupby(words, lambda w: "<|" not in w and _PLAIN.fullmatch(w) is not None):
            run = " ".join(run)
            out.append(self.encode(run) if is_plain else self._whole(run))
        return b"".join(out)


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One encoder for each worker process."""
    return WordEncoder(path)
