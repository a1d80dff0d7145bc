"""Token ids of texts by a public tokenizer file, with the ids of words already met kept in memory.

The vocabulary drops white space, so that the ids of a text are those of its
chunks between blanks and line feeds, one after the other. Chunks of plain Latin
letters, digits and ASCII signs are split into the tokenizer's own pieces here;
all others go through the whole tokenizer. Either way the library yields the ids.
"""

from __future__ import annotations

import os
import re
from array import array

from tidegauge.llm.common import worker_state

#: Fixed values of the tokenizer file: its pieces of lower-case text, for the characters that FAST admits.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
FAST = re.compile(r"[!-;=-~À-ÖØ-öø-ÿ]+")  # no "<": it may begin a special token


class _Pieces(dict):
    """Ids of a piece."""

    def __init__(self, model, spelled: dict[int, str], limit: int):
        super().__init__()
        self.model, self.spelled, self.limit = model, spelled, limit

    def __missing__(self, piece: str) -> bytes:
        found = self.model.tokenize(piece.encode().decode("latin-1").translate(self.spelled))
        ids = array("I", [x.id for x in found]).tobytes()
        if len(self) < self.limit:
            self[piece] = ids
        return ids


class _Chunks(dict):
    """Ids of a chunk."""

    def __init__(self, whole, pieces: _Pieces, limit: int):
        super().__init__()
        self.whole, self.pieces, self.limit = whole, pieces, limit

    def __missing__(self, chunk: str) -> bytes:
        if FAST.fullmatch(chunk):
            ids = b"".join(map(self.pieces.__getitem__, PIECES.findall(chunk.lower())))
        else:
            ids = b"".join(x.to_bytes(4, "little") for x in self.whole.encode(chunk, add_special_tokens=False).ids)
        if len(self) < self.limit:
            self[chunk] = ids
        return ids


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit numbers. The limits bound memory, not results."""

    def __init__(self, path: str, pieces: int = 400_000, chunks: int = 200_000):
        from tokenizers import Tokenizer, pre_tokenizers

        whole = Tokenizer.from_file(path)
        letters = sorted(pre_tokenizers.ByteLevel.alphabet())
        plain = {chr(b) for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
        shifted = iter(sorted(set(letters) - plain))
        spelled = {b: chr(b) if chr(b) in plain else next(shifted) for b in range(256)}
        self.chunks = _Chunks(whole, _Pieces(whole.model, spelled, pieces), chunks)

    def __call__(self, text: str) -> bytes:
        return b"".join(map(self.chunks.__getitem__, text.replace("\n", " ").split(" ")))


def encoder(path: str) -> Encoder:
    """One per worker and file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    known = worker_state("encoders", dict)
    if path not in known:
        known[path] = Encoder(path)
    return known[path]


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
