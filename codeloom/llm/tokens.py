"""Token ids of whole texts from a public tokenizer, fast enough for a corpus.

The word tokenizer lower-cases, drops white space, cuts a text into pieces (letter runs,
single digits, punctuation runs) and merges inside a piece only. So the ids of a text
are those of its pieces one after another, and each worker remembers the pieces it has
met. Texts with characters beyond the plain set below are left to the tokenizer whole,
and so is every text where the file's settings aren't those that this holds for.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import numpy as np

_LETTERS = "a-zß-öø-ÿ"
_MARKS = "«»“”‘’…–—€¿¡×÷"
#: Characters that NFC leaves alone and that every library lower-cases alike.
_PLAIN = re.compile(f"[\t-\r -~A-ZÀ-ÖØ-Þ{_LETTERS}{_MARKS}]*")
#: The tokenizer's own split, for lower-case plain text.
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\\s{_LETTERS}0-9]+")

#: The settings of a tokenizer file for which the above holds.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_PRE_TOKENIZERS = [
    {"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


def splits_into_pieces(settings: dict) -> bool:
    """Whether a tokenizer file with these settings gives a plain text the ids of its pieces."""
    parts = settings.get("normalizer") or {}, settings.get("pre_tokenizer") or {}
    model, added = settings.get("model") or {}, settings.get("added_tokens") or []
    return (
        parts[0].get("normalizers") == _NORMALIZERS
        and parts[1].get("pretokenizers") == _PRE_TOKENIZERS
        and model.get("type") == "BPE"
        and not model.get("dropout")
        and all(t["content"].startswith("<|") for t in added)
    )


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


class _Pieces(dict):
    """piece -> its ids as bytes of unsigned 32-bit numbers, in two generations of at most ``limit`` pieces each."""

    def __init__(self, model, limit: int):
        self.model, self.limit, self.letters, self.older = model, limit, _byte_letters(), {}

    def __missing__(self, piece: str) -> bytes:
        if (ids := self.older.get(piece)) is None:
            raw = piece.encode().decode("latin-1").translate(self.letters)
            ids = array("I", [t.id for t in self.model.tokenize(raw)]).tobytes()
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class WordTokens:
    def __init__(self, path: str, limit: int = 100_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            self.in_pieces = splits_into_pieces(json.load(file))
        self.pieces = _Pieces(self.tokenizer.model, limit)

    def __call__(self, text: str) -> np.ndarray:
        """The ids of one text, unsigned 32-bit; no special tokens are added."""
        if self.in_pieces and "<|" not in text and _PLAIN.fullmatch(text):
            return np.frombuffer(b"".join(map(self.pieces.__getitem__, _PIECES.findall(text.lower()))), dtype="<u4")
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")


@lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    """One encoder for each worker process and file."""
    return WordTokens(path)
