"""Encoding of whole texts with a public tokenizer file, with a bounded cache of chunks.

Texts are cut only where the tokenizer's own pre-tokenizer always cuts: for byte-level BPE before
a single space between two other characters, for word BPE at any space. The ids of a chunk are
then independent of its neighbours, so joined chunks equal the encoding of the whole text. Strings of
special tokens hold no space, and become their ids as in the library's plain call.
"""

from __future__ import annotations

import gc
import os
import re
import sys
from array import array

import numpy as np

#: Chunks whose ids a worker remembers; the cache is emptied when it is full.
CACHED_CHUNKS = 1_400_000

_CUT = re.compile(r"(?<=\S) (?=\S)")
_ODD_SPACE = re.compile(r"[^\S \n]")
#: A Latin word and the marks behind it, and two such with a line feed between: the pre-tokenizer makes
#: one piece of each word and each run of marks (no apostrophe, no ``<``), and none or one of the line feed.
_LATIN = r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([].,;:!?&%$*#@+=~^\"()[{}/\\-]*)"
_WORD = re.compile(_LATIN + r"\Z")
_TWO_LINES = re.compile(_LATIN + r"\n" + _LATIN + r"\Z")


def _byte_letters() -> dict[int, str]:
    """The character by which byte-level vocabularies write each byte: itself if it prints, else 256 and up."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + i) for i, b in enumerate(hidden)}}


class ChunkEncoder:
    """``encode`` gives each text's ids as little-endian bytes of ``dtype``."""

    def __init__(self, path: str, words: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.piece = self.tok.model.tokenize
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size(True) <= 65536 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.words = words
        self.letters = _byte_letters()
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = self.first if words else {}
        self.marks: dict[str, bytes] = {"": b""}
        self.packed = [self._packed([i]) for i in range(self.tok.get_vocab_size(True))]
        self.line_feed = b"" if words else self._packed([t.id for t in self.piece(self.letters[10])])

    def _packed(self, ids) -> bytes:
        a = array(self.code, ids)
        if sys.byteorder == "big":
            a.byteswap()
        return a.tobytes()

    def _piece(self, piece: str) -> bytes:
        """Ids of one pre-token (Latin letters or marks, and a space before)."""
        if self.words:
            piece = piece.lower()
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(self.letters)
        elif piece[0] == " ":
            piece = self.letters[32] + piece[1:]
        packed = self.packed
        return b"".join([packed[t.id] for t in self.piece(piece)])

    def _remembered(self, known: dict, text: str, lead: str) -> bytes:
        ids = known.get(text)
        if ids is None:
            ids = known[text] = self._piece(lead + text)
        return ids

    def _learn(self, known: dict, chunks: set, lead: str) -> None:
        rest = []
        for c in chunks:
            m = _WORD.match(c)
            if m is not None:
                word, marks = m.groups()
                ids = self._remembered(known, word, lead)
                if marks:
                    known[c] = ids + self._remembered(self.marks, marks, "")
                continue
            m = _TWO_LINES.match(c)
            if m is None:
                rest.append(c)
                continue
            word, marks, after, more = m.groups()
            known[c] = b"".join([self._remembered(known, word, lead), self._remembered(self.marks, marks, ""), self.line_feed,
                                 self._remembered(self.first, after, ""), self._remembered(self.marks, more, "")])
        if rest:
            got = self.tok.encode_batch_fast([lead + c for c in rest], add_special_tokens=False)
            known.update((c, self._packed(e.ids)) for c, e in zip(rest, got))

    def _chunks(self, text: str) -> list[str]:
        parts = text.split(" ")
        if self.words or not ("" in parts or " \n" in text or "\n " in text or _ODD_SPACE.search(text)):
            return parts
        return _CUT.split(text)

    def _joined(self, known: dict, chunks: list[str], lead: str) -> bytes:
        ids = list(map(known.get, chunks))
        if None in ids:
            if len(known) > CACHED_CHUNKS:
                known.clear()
                self._learn(known, set(chunks), lead)
            else:
                self._learn(known, {c for c, x in zip(chunks, ids) if x is None}, lead)
            ids = map(known.__getitem__, chunks)
        return b"".join(ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        collecting = gc.isenabled()
        gc.disable()  # many short-lived lists, no cycles
        try:
            out = []
            for t in texts:
                chunks = self._chunks(t)
                if self.words:
                    out.append(self._joined(self.first, chunks, ""))
                else:
                    out.append(self._joined(self.first, chunks[:1], "") + self._joined(self.later, chunks[1:], " "))
            return out
        finally:
            if collecting:
                gc.enable()


_ENCODERS: dict = {}


def encoder(path: str, words: bool) -> ChunkEncoder:
    """The worker's encoder of a file (made once a process)."""
    if (path, words) not in _ENCODERS:
        _ENCODERS[path, words] = ChunkEncoder(path, words)
    return _ENCODERS[path, words]
