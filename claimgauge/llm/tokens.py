"""Token ids of whole texts by the tokenizers library, as little-endian 16- or 32-bit integers.

Between two characters that are no white space, a single space is always a boundary of the byte-level
pre-tokenizer and belongs to what follows. So a text is cut there and every distinct chunk is encoded
once per worker. Texts with other runs of spaces or an added token of the file, such as its special
one, are encoded in one call. Both give the ids of one call over the whole text, where an added token
is its own id.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np

#: Most chunks and words that a worker remembers, some 200 bytes each. The first ones stay: they are the frequent ones.
CACHE_CHUNKS, CACHE_WORDS = 300_000, 150_000
#: Punctuation that never joins a letter before it into one part; an apostrophe may.
_PUNCTUATION = ".,;:!?*%&$#|<>()"
_LETTERS = [chr(c) for c in [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]]
_LATIN = re.compile(f"[{''.join(_LETTERS)}]+")


class ChunkEncoder:
    """Encodes texts with one byte-level tokenizer; keep one per worker."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        self.cache_words = cache_words
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.typecode = "H" if self.width == 2 else "I"
        # How the pre-tokenizer spells a space and each letter.
        spelled = {c: self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in [" ", *_LETTERS]}
        self.space, self.spelling = spelled[" "], str.maketrans(spelled)
        self.model, self.feed = self.tokenizer.model, self.direct("\n")
        self.words: dict[str, bytes] = {}
        self.starts: dict[str, bytes] = {}
        self.endings: dict[str, bytes] = {}
        self.known: dict[str, bytes | None] = {"": None}

    def direct(self, text: str) -> bytes:
        """The ids by one call over the text."""
        ids = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return np.asarray(ids, self.dtype).tobytes()

    def _word(self, word: str, space: str) -> bytes | None:
        """Ids of a word of Latin letters after ``space`` or nothing; None for any other word."""
        if not (word.isalpha() and (word.isascii() or _LATIN.fullmatch(word))):
            return None
        spelled = space + (word if word.isascii() else word.translate(self.spelling))
        return array(self.typecode, [token.id for token in self.model.tokenize(spelled)]).tobytes()

    def _part(self, part: str, known: dict[str, bytes], space: str, blank: str) -> bytes:
        """Ids of a part without line feeds: a word and its punctuation, or anything else in one call."""
        word = part.rstrip(_PUNCTUATION)
        ids = known.get(word)
        if ids is None:
            ids = self._word(word, space)
            if ids is None:
                return self.direct(blank + part)
            if len(known) < self.cache_words:
                known[word] = ids
        if len(word) == len(part):
            return ids
        rest = part[len(word) :]
        ending = self.endings.get(rest)
        if ending is None:
            ending = self.direct(rest)
            if len(self.endings) < self.cache_words:
                self.endings[rest] = ending
        return ids + ending

    def _chunk(self, chunk: str) -> bytes | None:
        """Ids of the chunk after a space; None if it begins or ends in white space itself."""
        if chunk[0].isspace() or chunk[-1].isspace():
            return None
        if "\n" not in chunk:
            return self._part(chunk, self.words, self.space, " ")
        before, after = chunk.split("\n", 1)
        if "\n" in after or before[-1].isspace() or after[0].isspace():
            return self.direct(" " + chunk)
        return self._part(before, self.words, self.space, " ") + self.feed + self._part(after, self.starts, "", "")

    def encode(self, text: str) -> bytes:
        """Ids of the whole text, ``width`` bytes each; empty for an empty text."""
        if not text:
            return b""
        first, *rest = text.split(" ")
        if not first or first[-1].isspace() or any(token in text for token in self.added):
            return self.direct(text)
        known = self.known
        new = {chunk: self._chunk(chunk) for chunk in set(rest) if chunk not in known}
        if new and len(known) < CACHE_CHUNKS:
            known.update(new)
            new = {}
        if new:
            found = [new[chunk] if chunk in new else known[chunk] for chunk in rest]
        else:
            found = [known[chunk] for chunk in rest]
        if None in found:
            return self.direct(text)
        return self.direct(first) + b"".join(found)


@lru_cache(maxsize=4)
def encoder(path: str, cache_words: int = CACHE_WORDS) -> ChunkEncoder:
    """The worker's own encoder for a tokenizer file, loaded once."""
    return ChunkEncoder(path, cache_words)
