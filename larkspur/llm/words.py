"""A cache of words for tokenizers that split text by the byte-level pattern.

No match of that pattern reaches across a single blank between two characters that are not white space: the blank
starts a match. Texts may be cut there and the parts encoded alone. Texts with a blank beside other white space
are left whole.
"""

from __future__ import annotations

from collections.abc import Callable

import regex

CACHED_WORDS = 400_000
# Longer strings are encoded anew each time, so that the cache stays small.
_CACHED_CHARS = 64
_RUN = regex.compile(r"\s | \s")


class WordCache:
    """Encodes texts word by word, each distinct word of a batch once; emptied when full.

    ``encode_words`` encodes words as they are after a blank; without it they are strings like others.
    """

    def __init__(
        self,
        encode: Callable[[list[str]], list[bytes]],
        limit: int = CACHED_WORDS,
        encode_words: Callable[[list[str]], list[bytes]] | None = None,
    ) -> None:
        self.encode_strings = encode
        self.encode_words = encode_words or (lambda words: encode([" " + w for w in words]))
        self.limit = limit
        # Ids of words after a blank, by the word.
        self.spaced: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.spaced) > self.limit:
            self.spaced.clear()
        split = [t.split(" ") for t in texts]
        new = set().union(*[parts[1:] for parts in split]).difference(self.spaced)
        # Only new words can lie beside other white space, as no word is kept that does.
        if _RUN.search(f" {' '.join(new)} ") or any(parts[0][-1:].isspace() for parts in split):
            split = [[t] if _RUN.search(t) else parts for t, parts in zip(texts, split, strict=True)]
            new = set().union(*[parts[1:] for parts in split]).difference(self.spaced)
        # A trailing blank leaves an empty word, a blank alone.
        words = [w for w in new if w]
        # The first part of each text has no blank before it.
        coded = self.encode_strings([parts[0] for parts in split] + ([" "] if "" in new else []))
        self.spaced.update(zip(words, self.encode_words(words), strict=True))
        if "" in new:
            self.spaced[""] = coded[-1]
        get = self.spaced.__getitem__
        out = [first + b"".join(map(get, parts[1:])) for first, parts in zip(coded, split, strict=False)]
        self.spaced.pop("", None)
        for word in words:
            if len(word) > _CACHED_CHARS:
                del self.spaced[word]
        return out
