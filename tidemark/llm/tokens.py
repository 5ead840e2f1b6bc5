"""Pre-token splitting of byte-level BPE vocabularies, and library encoding with one lookup per distinct pre-token.

A byte-level vocabulary never merges across pre-tokens, so the ids of a text are the ids of its pre-tokens in
a row.  Pre-tokens repeat a great deal: each worker encodes a pre-token once with the tokenizers library and
keeps its packed ids in a bounded table.
"""

from __future__ import annotations

import os
import re
import struct
import zlib

import numpy as np

from tidemark.llm.common import held

#: The split rule of the vocabulary, written for ``re``.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Characters outside these ranges are in other classes for ``re`` than for the library: such texts go to the library's own splitter.
OTHERS = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-՗؀-߿ऀ-ৠ -⁯぀-㆏一-鿿가-힣]")
#: The same, with all white space but the blank and the line feed.
ODD = re.compile("[^\n\x20-\x84\x86-\x9f\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-՗؀-߿ऀ-ৠ​-‧‪-‮‰-⁞぀-㆏一-鿿가-힣\x00-\x08\x0e-\x1b]")
SPECIAL = "<|endoftext|>"
#: Signs that form one pre-token behind a word.
ENDS = "!\"#$%&()*+,-./:;<=>?@[\\]^`{|}~"
VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_of_char() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself, the other bytes follow from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


_open: dict[str, object] = {}


def library(path: str):
    """The library's tokenizer of the file, opened once in each worker, single threaded."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _open:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _open[path] = tokenizer
    return _open[path]


class Known(dict):
    """Values by key, made where missing.  ``age`` bounds it: what was not asked for in the last generation goes."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def age(self, most: int) -> None:
        if len(self) > most:
            self.old = dict(self)
            self.clear()


def is_plain(text: str) -> bool:
    """White space is single blanks and line feeds only, and ``PIECES`` splits the text as the library does."""
    return not (ODD.search(text) or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or SPECIAL in text)


def pieces_of(cut: str) -> list[str]:
    """The pre-tokens of a cut of a plain text, which has lost its blank or begins with a line feed: mostly letters, or letters and one run of signs."""
    if cut.isalpha():
        return [" " + cut]
    word = cut.rstrip(ENDS)
    if word.isalpha():
        return [" " + word, cut[len(word) :]]
    return PIECES.findall(cut if cut[:1] == "\n" else " " + cut)


class Encoder:
    """Ids of texts as packed little-endian integers of ``width`` bytes.

    A plain text is cut before each blank and line feed, where a pre-token always ends; the cuts are looked up whole.
    """

    def __init__(self, path: str, most: int = 400_000):
        self.tokenizer, self.most = library(path), most
        self.width = 2 if self.tokenizer.get_vocab_size(True) <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.shown = {b: c for c, b in byte_of_char().items()}
        self.blank, self.tokenize = self.shown[32], self.tokenizer.model.tokenize
        self.pack = [struct.Struct("<" + ("H" if self.width == 2 else "I") * n).pack for n in range(16)]
        self.pieces, self.cuts = Known(self._piece), Known(self._cut)

    def _pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def _ids(self, said: str) -> bytes:
        """The packed ids of a pre-token in the vocabulary's stand-ins."""
        found = self.tokenize(said)
        n = len(found)
        return self.pack[n](*[t.id for t in found]) if n < 16 else self._pack([t.id for t in found])

    def _piece(self, piece: str) -> bytes:
        raw = piece.encode()
        # Printable ASCII stands for itself, but for the blank.
        return self._ids(piece.replace(" ", self.blank) if raw.isascii() and piece.isprintable() else "".join(map(self.shown.__getitem__, raw)))

    def _cut(self, cut: str) -> bytes:
        if cut.isalpha():
            return self._ids(self.blank + (cut if cut.isascii() else "".join(map(self.shown.__getitem__, cut.encode()))))
        word = cut.rstrip(ENDS)
        if word.isalpha():  # letters and one run of signs: the word is known from elsewhere as often as not
            return self.cuts[word] + self.pieces[cut[len(word) :]]
        found = PIECES.findall(cut if cut[:1] == "\n" else " " + cut)
        return self._piece(found[0]) if len(found) == 1 else b"".join(map(self.pieces.__getitem__, found))  # one piece is kept once, as the cut

    def _text(self, text: str | None) -> bytes:
        if not text:
            return b""
        if is_plain(text):
            first, *rest = text.replace("\n", " \n").split(" ")
            return b"".join(map(self.pieces.__getitem__, PIECES.findall(first))) + b"".join(map(self.cuts.__getitem__, rest))
        if SPECIAL in text or OTHERS.search(text):
            return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.pieces.__getitem__, PIECES.findall(text)))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text, null as the empty text."""
        out = list(map(self._text, texts))
        self.pieces.age(self.most)
        self.cuts.age(self.most)
        return out


def encoder(path: str) -> Encoder:
    """The worker's encoder of this vocabulary."""
    return held(f"encoder {path}", lambda: Encoder(path))


def crc_of(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
