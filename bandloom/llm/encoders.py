"""Cached whole-library encoding for the two byte-pair vocabularies.

The library is asked for the ids of each *distinct* stretch of text that its own
pre-tokenizer provably treats alone; results are kept in a bounded dictionary per
Python worker. Texts for which the stretches are not provably independent go to the
library whole.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache
from itertools import islice

import numpy as np

#: White space beyond plain blanks and line feeds; its runs are left to the library.
OTHER_SPACE = re.compile(r"[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Entries kept per worker (about 160 MB) before the cache starts anew.
CACHE_ENTRIES = 800_000
#: The same for ids, of which a plain word costs little to find again (about 100 MB).
ID_ENTRIES = 500_000


@lru_cache(maxsize=4)
def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _specials(library) -> list[str]:
    return [t.content for t in library.get_added_tokens_decoder().values()]


#: A run of these after an ASCII letter or digit, at a stretch's end, is a pre-token of its own.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class _Counts(dict):
    """Token count of ``prefix + key``."""

    def __init__(self, library, prefix: str, marks: dict | None = None):
        super().__init__()
        self._library, self._prefix = library, prefix
        self._marks = self if marks is None else marks

    def __missing__(self, key: str) -> int:
        stem = key.rstrip(MARKS)
        if stem and len(stem) < len(key) and stem[-1].isascii() and stem[-1].isalnum():
            n = self[stem] + self._marks[key[len(stem) :]]
        else:
            n = len(self._library.encode(self._prefix + key, add_special_tokens=False).ids)
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        self[key] = n
        return n


class ByteLevelCounter:
    """Token counts by a byte-level vocabulary whose words may carry one leading blank.

    A blank that no white space follows always starts a new pre-token, and a lone line
    feed between non-blank characters is always one of its own, whatever stands before;
    so lines and their blank-separated words can be counted one by one.
    """

    def __init__(self, path: str):
        self.library = _library(path)
        self.specials = _specials(self.library)
        self.first = _Counts(self.library, "")
        self.rest = _Counts(self.library, " ", self.first)
        self.line_feed = len(self.library.encode("\n", add_special_tokens=False).ids)

    def plain(self, text: str) -> bool:
        """Whether the words of ``text`` are provably independent."""
        return not (
            "  " in text or " \n" in text or "\n " in text or "\n\n" in text or text.endswith(" ")
            or OTHER_SPACE.search(text) or any(s in text for s in self.specials)
        )

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.plain(text):
            return len(self.library.encode(text, add_special_tokens=False).ids)
        lines = text.split("\n")
        n = self.line_feed * (len(lines) - 1)
        first, rest = self.first, self.rest
        for line in lines:
            if line:
                head, *tail = line.split(" ")
                n += (first[head] if head else 0) + sum(map(rest.__getitem__, tail))
        return n

    def bounds(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Start offset of every pre-token run, in characters, and the tokens before it.

        The last entry of both arrays is for the end of the text.
        """
        if text and self.plain(text):
            starts, before, at, n = [], [], 0, 0
            for k, line in enumerate(text.split("\n")):
                if k:
                    starts.append(at)
                    before.append(n)
                    at += 1
                    n += self.line_feed
                for j, word in enumerate(line.split(" ")):
                    if j or word:
                        starts.append(at)
                        before.append(n)
                        at += len(word) + (j > 0)
                        n += self.rest[word] if j else self.first[word]
            starts.append(at)
            before.append(n)
            return np.array(starts, np.int64), np.array(before, np.int64)
        encoding = self.library.encode(text, add_special_tokens=False)
        words, offsets = encoding.word_ids, encoding.offsets
        new = [i for i in range(len(words)) if i == 0 or words[i] is None or words[i] != words[i - 1]]
        starts = [offsets[i][0] for i in new] + [len(text)]
        return np.array(starts, np.int64), np.array([*new, len(words)], np.int64)


_MARKS = MARKS.encode()


#: Lower-case Latin letters: a stretch of them alone is normal already, and one pre-token.
_LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
_PLAIN = re.compile(f"[{_LETTERS}]+")


class _Ids(dict):
    """Little-endian unsigned 32-bit ids of a stretch without ASCII white space.

    A stretch of plain letters goes to the library's model at once, as its normalizer and
    pre-tokenizer would leave it whole; where a vocabulary's do not, that way is not taken.
    """

    def __init__(self, library):
        super().__init__()
        self._library = library
        self._tokenize = library.model.tokenize
        written = {c: "".join(x for x, _ in library.pre_tokenizer.pre_tokenize_str(c)) if library.pre_tokenizer else c for c in _LETTERS}
        self._letters = str.maketrans({c: x for c, x in written.items() if c != x})
        self._direct = all(self._model(x) == self._whole(x) for x in (*_LETTERS, _LETTERS, _LETTERS[::-1], "theßofé"))

    def _model(self, text: str) -> bytes:
        return array("I", [t.id for t in self._tokenize(text.translate(self._letters))]).tobytes()

    def _whole(self, text: str) -> bytes:
        return np.array(self._library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, key: bytes) -> bytes:
        stem = key.rstrip(_MARKS)
        if stem and len(stem) < len(key) and stem[-1:].isalnum() and b"<|" not in key:  # no special token is cut
            found = self[stem] + self[key[len(stem) :]]
        else:
            text = key.decode("utf-8")
            found = self._model(text) if self._direct and _PLAIN.fullmatch(text) else self._whole(text)
        if len(self) >= ID_ENTRIES:
            early = dict(islice(self.items(), ID_ENTRIES // 4))  # frequent words came first
            self.clear()
            self.update(early)
        self[key] = found
        return found


class WordLevelIds:
    """Ids by a vocabulary that drops white space and lower-cases: each stretch between
    ASCII white space is encoded alone."""

    def __init__(self, path: str):
        self.library = _library(path)
        self.specials = [s.lower().encode() for s in _specials(self.library)]
        self.cache = _Ids(self.library)

    def ids(self, text: str) -> bytes:
        raw = text.encode("utf-8", "surrogatepass")
        low = raw.lower()
        if any(s in low for s in self.specials):  # their spelling is case-sensitive
            low = raw
        return b"".join(map(self.cache.__getitem__, low.split()))


@lru_cache(maxsize=2)
def byte_level_counter(path: str) -> ByteLevelCounter:
    return ByteLevelCounter(path)


@lru_cache(maxsize=2)
def word_level_ids(path: str) -> WordLevelIds:
    return WordLevelIds(path)
