"""Encoding with a tokenizer file of the tokenizers library, one lookup per word.

Both supported vocabularies split a text into words before any merge, so the ids of a text
are the ids of its words in a row.  A worker keeps the ids of the words that it has met and
asks the library only for new ones.  Whatever the simple rules do not cover (runs of white
space, contractions, unusual characters) is handed to the library as it stands; every rule
below only splits where the library itself is certain to split.
"""

from __future__ import annotations

import re
import sys
from array import array

import numpy as np

#: Words that a worker remembers at least, and half of those that it does at most (some 250
#: bytes each): when so many are new, those not met since the last time are forgotten.
CACHE_WORDS = 200_000

# ASCII punctuation that forms one piece when it ends a word.  Quotes may begin a contraction.
_TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
# White space to Python but not to the library.
_ODD_SPACE = "\x1c\x1d\x1e\x1f"
_PIECES = re.compile(r" ?\S+|\s+(?!\S)|\s+")
# White space other than blanks and line ends, of which no text with the plain form has any,
# and runs of those two, of which it has none either.
_OTHER_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
_ASCII_SPACE = [c for c in _OTHER_SPACE if c.isascii()]
_RUNS = ("  ", " \n", "\n ", "\n\n")


def _byte_alphabet() -> dict[int, str]:
    """Byte-level vocabularies write each byte as one printable character."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _is_plain(text: str) -> bool:
    """Whether white space is single blanks and line ends between words, and nothing else."""
    if text[0].isspace() or text[-1].isspace() or any(run in text for run in _RUNS):
        return False
    return not any(c in text for c in (_ASCII_SPACE if text.isascii() else _OTHER_SPACE))


def _little_endian(ids: list[int]) -> bytes:
    data = array("I", ids)
    if sys.byteorder != "little":
        data.byteswap()
    return data.tobytes()


_NOTHING: dict[str, bytes] = {}


class WordEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    ``lower_words=True`` is for a vocabulary that lower-cases and drops white space (words
    are told apart by an end marker), ``False`` for one in which a word carries the space
    before it.  With ``added_tokens`` the contents of added tokens are those tokens, as in the
    library's plain call, else they are text like any other.
    """

    def __init__(self, path: str, lower_words: bool, cache_words: int = CACHE_WORDS, added_tokens: bool = False):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = not added_tokens
        # Special tokens are text when they are not asked for, other added tokens never are.
        added = [t for t in self._tokenizer.get_added_tokens_decoder().values() if added_tokens or not t.special]
        self._added = [t.content for t in added]
        self._normalize = self._tokenizer.normalizer.normalize_str if any(t.normalized for t in added) else None
        self._model = self._tokenizer.model
        self._lower = lower_words
        self._limit = cache_words
        self._bytes = _byte_alphabet()
        self._blank = self._bytes[ord(" ")]
        self._spaced: dict[str, bytes] = {}  # words after a space (or, lower-cased vocabularies, any)
        self._bare: dict[str, bytes] = {}  # pieces without a space before them
        self._tails: dict[str, bytes] = {}
        self._older: dict[int, dict[str, bytes]] = {}
        self._newline = None if self._lower else self._ask("\n")

    def _forget(self) -> None:
        """Begin a new generation; words of the last one return when they are met again."""
        self._older = {id(new): old for new, old in ((self._begin("_spaced")), (self._begin("_bare")))}
        self._tails = {}

    def _begin(self, name: str) -> tuple[dict[str, bytes], dict[str, bytes]]:
        old = getattr(self, name)
        setattr(self, name, {})
        return getattr(self, name), old

    def _ask(self, text: str) -> bytes:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, stem: str, space: str) -> bytes:
        """Ids of a word of letters, with the space before it."""
        # Letters of ASCII stand for themselves.
        mapped = stem if stem.isascii() else stem.encode().decode("latin-1").translate(self._bytes)
        if space:
            mapped = self._blank + mapped
        return _little_endian([t.id for t in self._model.tokenize(mapped)])

    def _word(self, word: str, space: str, known: dict[str, bytes]) -> bytes:
        """Ids of a word not met in this generation.

        A word and the signs after it are kept apart, until a word that is known comes with signs.
        """
        if word[0] == "\n":  # only in texts of the plain form, see ``encode``
            found = known[word] = self._newline + self._words([word[1:]], self._bare, "")[0]
            return found
        stem = word.rstrip(_TAIL)
        # Letters of the Latin blocks are their own composed form, and one letter when lower-cased.
        if not (stem.isalpha() and (stem.isascii() or (max(stem) < "ɐ" and "İ" not in stem))):
            found = known[word] = self._older.get(id(known), {}).get(word) or self._ask(space + word)
            return found
        found = fresh = known.get(stem)
        if found is None:
            found = self._older.get(id(known), _NOTHING).get(stem)
            found = known[stem] = found or self._piece(stem.lower() if self._lower else stem, space)
        if len(stem) < len(word):
            tail = word[len(stem) :]
            ids = self._tails.get(tail)
            if ids is None:
                ids = self._tails[tail] = self._ask(tail)
            found += ids
            if fresh is not None:
                known[word] = found
        return found

    def _words(self, words: list[str], known: dict[str, bytes], space: str) -> list[bytes]:
        found = list(map(known.get, words))
        at = -1
        for _ in range(found.count(None)):
            at = found.index(None, at + 1)
            found[at] = known.get(words[at]) or self._word(words[at], space, known)
        return found

    def _holds_added(self, text: str) -> bool:
        """Whether an added token may be found in a text: those are looked for before words are."""
        if any(t in text for t in self._added):
            return True
        return self._normalize is not None and any(t in self._normalize(text) for t in self._added)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self._holds_added(text):
            return self._ask(text)
        if len(self._spaced) + len(self._bare) > self._limit:
            self._forget()
        if any(c in text for c in _ODD_SPACE):
            return self._ask(text)
        if self._lower:
            return b"".join(self._words(text.split(), self._spaced, ""))
        if not _is_plain(text):
            return b"".join(self._pieces(_PIECES.findall(text)))
        # A word that begins a line takes the line end along; the first one has none.
        first, *words = text.replace("\n", " \n").split(" ")
        return b"".join(self._words([first], self._bare, "") + self._words(words, self._spaced, " "))

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Pieces of a text with runs of white space: a word with the space before it, or a run."""
        out = []
        for piece in pieces:
            spaced = piece[0] == " " and len(piece) > 1 and not piece[1].isspace()
            known, word = (self._spaced, piece[1:]) if spaced else (self._bare, piece)
            ids = known.get(word)
            if ids is None and spaced:
                ids = self._word(word, " ", known)
            elif ids is None:
                ids = known[word] = self._ask(word)
            out.append(ids)
        return out
