"""Ids by the tokenizers library, each distinct piece encoded once per worker."""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np

from grainmill.llm.pieces import PieceTable, byte_level_cuts, kept, word_level_cuts

#: Words of plain Latin letters: one pre-token, whose normal form is its lower case.
_PLAIN = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def _byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTE_ALPHABET = _byte_alphabet()


@kept
def piece_table(path: str) -> PieceTable:
    """The table of a vocabulary file, kept by the worker from task to task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenize = tokenizer.model.tokenize
    words = "Lowercase" in repr(tokenizer.normalizer)

    def encode(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found: list = [None] * len(pieces)
        joined = b"".join(pieces)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        start = np.cumsum(size) - size
        data = np.frombuffer(joined, np.uint8)
        blank, other = data[start] == 32, ~_LETTER[data]
        other[start] &= ~blank
        letters = ~np.logical_or.reduceat(other, start) & (size > blank)  # ASCII letters, after a blank or none
        spelled = (joined.lower() if words else joined).decode("latin-1").translate(BYTE_ALPHABET)
        for i, a, b in zip(np.flatnonzero(letters).tolist(), start[letters].tolist(), (start + size)[letters].tolist()):
            found[i] = [t.id for t in tokenize(spelled[a:b])]
        rest = []
        for i in np.flatnonzero(~letters).tolist():
            text = pieces[i].decode("utf-8", "replace")
            if _PLAIN.fullmatch(text):
                piece = text.lower().encode() if words else pieces[i]
                found[i] = [t.id for t in tokenize(piece.decode("latin-1").translate(BYTE_ALPHABET))]
            else:
                rest.append((i, text))
        for (i, _), e in zip(rest, tokenizer.encode_batch([t for _, t in rest], add_special_tokens=False)):
            found[i] = e.ids
        width = np.fromiter(map(len, found), np.int64, len(found))
        return width, np.fromiter(chain.from_iterable(found), np.int32, int(width.sum()))

    # a word-level vocabulary has few distinct pieces, so half the room serves as well
    table = PieceTable(word_level_cuts, encode, limit=500_000, most_bytes=1 << 23) if words else PieceTable(byte_level_cuts, encode)
    table.item = "<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4"  # what an id fits in
    return table
