"""Token ids of public tokenizer files, as little-endian unsigned 32-bit bytes.

Both encoders give exactly the ids that the tokenizers library gives for the same file with add_special_tokens=False. A
special string in a text gets its own id there, and so it does here; special_as_text=True takes it as ordinary text, as
the library's encode_special_tokens does. Its own speed on whole texts, about 1.2 MB a CPU second, would
need three times the CPU budget, so a text is cut where the file's own splitting rule always cuts (ASCII white
space), each distinct piece is merged once a worker by the same merge table, and the bytes are joined. What these
cuts can't be proven for (other white space; special strings; characters beyond Latin) goes through the tokenizers
library itself.
"""

from __future__ import annotations

import functools
import json
import os
import re
from array import array

import public_tokenizers
import regex
import tiktoken
from tokenizers import Tokenizer

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")

#: Pieces that a worker remembers; beyond these it merges a piece each time it comes.
REMEMBERED = 500_000

_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
_BYTE_PIECES = re.compile(r" ?[^ \t-\r]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+")
_WORD_PIECES = re.compile(r"[^ \t-\r]+")
_LATIN = re.compile("[!-~\xa1-ɏ]+")
#: The splitting rule of the word file, a fixed value.
_WORD_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Stands for the end of a word in the merge table; no UTF-8 text has this byte.
_END = b"\xff"


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Library:
    """The library's tokenizer of a file, and its special strings."""

    def __init__(self, path: str, special_as_text: bool) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        special = [] if special_as_text else [t["content"] for t in json.load(open(path, encoding="utf-8"))["added_tokens"]]
        #: How every special string starts; where they start differently, each of them.
        self.marks = [os.path.commonprefix(special)] if special and os.path.commonprefix(special) else special

    def has_special(self, text: str) -> bool:
        return any(m in text for m in self.marks)

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids


class _Pieces(dict):
    """Piece to id bytes, filled on demand."""

    def __init__(self, merge) -> None:
        super().__init__()
        self.merge = merge

    def __missing__(self, piece: str) -> bytes:
        found = array("I", self.merge(piece)).tobytes()
        if len(self) < REMEMBERED:
            self[piece] = found
        return found


class ByteEncoder:
    def __init__(self, path: str = BYTE_BPE, special_as_text: bool = False) -> None:
        of = _byte_of()
        model = json.load(open(path, encoding="utf-8"))
        special = {t["content"] for t in model["added_tokens"]}
        ranks = {bytes(of[c] for c in k): v for k, v in model["model"]["vocab"].items() if k not in special}
        merged = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = len(model["model"]["vocab"])
        self.library = _Library(path, special_as_text)
        self.whole = merged.encode_ordinary
        self.single = merged._core_bpe.encode_single_piece
        self.pieces = _Pieces(self.merge)

    def merge(self, piece: str) -> list[int]:
        """Letters alone are one unit of the splitting rule, and so are letters after a space: they need no splitting."""
        return self.single(piece.encode()) if piece.removeprefix(" ").isalpha() else self.whole(piece)

    def encode(self, text: str) -> bytes:
        if _ODD_SPACE.search(text) or self.library.has_special(text):
            return array("I", self.library.ids(text)).tobytes()
        return b"".join(map(self.pieces.__getitem__, _BYTE_PIECES.findall(text)))


class WordEncoder:
    def __init__(self, path: str = WORD_BPE, special_as_text: bool = False) -> None:
        of = _byte_of()
        model = json.load(open(path, encoding="utf-8"))
        special = {t["content"] for t in model["added_tokens"]}
        end = model["model"]["end_of_word_suffix"]

        def raw(token: str) -> bytes:
            return bytes(of[c] for c in token.removesuffix(end)) + _END * token.endswith(end)

        vocab = {k: v for k, v in model["model"]["vocab"].items() if k not in special}
        ids = {raw(k): v for k, v in vocab.items()}
        #: A word starts as its characters, the last with the end mark: those come first, then the merges in order.
        order = [bytes([b]) for b in range(256)] + [bytes([b]) + _END for b in range(256)]
        order += [raw("".join(m) if isinstance(m, list) else m.replace(" ", "", 1)) for m in model["model"]["merges"]]
        order = list(dict.fromkeys(order))
        self.ids = [ids.get(x, -1) for x in order]
        self.core = tiktoken.Encoding("words", pat_str=r".+", mergeable_ranks={x: i for i, x in enumerate(order)}, special_tokens={})._core_bpe
        self.size = len(model["model"]["vocab"])
        self.library = _Library(path, special_as_text)
        self.pieces = _Pieces(self.merge)

    def merge(self, piece: str) -> list[int]:
        if not _LATIN.fullmatch(piece):
            return self.library.ids(piece)
        out: list[int] = []
        for word in _WORD_SPLIT.findall(piece.lower()):
            out += [self.ids[i] for i in self.core.encode_single_piece(word.encode() + _END)]
        return out

    def encode(self, text: str) -> bytes:
        if self.library.has_special(text):
            return array("I", self.library.ids(text)).tobytes()
        return b"".join(map(self.pieces.__getitem__, _WORD_PIECES.findall(text)))


@functools.lru_cache(maxsize=2)
def byte_encoder(path: str = BYTE_BPE, special_as_text: bool = False) -> ByteEncoder:
    return ByteEncoder(path, special_as_text)


@functools.lru_cache(maxsize=2)
def word_encoder(path: str = WORD_BPE, special_as_text: bool = False) -> WordEncoder:
    return WordEncoder(path, special_as_text)
