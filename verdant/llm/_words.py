"""Word hashes inside tasks: one 64-bit hash per different word, looked up for all others."""

from __future__ import annotations

import numpy as np

#: Different words a task remembers before it starts anew; bounds its memory, changes no result.
REMEMBERED = 1_000_000


class Hashes(dict):
    """word (bytes) -> its 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > REMEMBERED:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def blank_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return text.encode().lower().split() if text else []


#: Digits, lower-case letters and everything beyond ASCII stay, A-Z become lower case, the rest parts words.
_ALNUM = bytes(b if b >= 128 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


def alnum_words(text: str | None) -> list[bytes]:
    """Runs of digits, letters and non-ASCII characters, A-Z in lower case."""
    return text.encode().translate(_ALNUM).split() if text else []
