"""Pre-tokens of the byte-level vocabularies, and their encoding one distinct pre-token at a time."""

from __future__ import annotations

import base64
import json
import re
import struct
import unicodedata
from functools import lru_cache

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

#: White space as Unicode has it; Python's own \s also takes U+001C to U+001F.
_SPACE = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Pre-tokens that a task remembers, and the longest that it remembers.
CACHE, LONGEST = 400_000, 48


def _ranges(kind: str) -> str:
    """The characters up to U+FFFF of a general category, as ranges of a character class."""
    marks = [unicodedata.category(chr(c))[0] == kind for c in range(0x10000)] + [False]
    edges = [c for c in range(0x10001) if marks[c] != (c > 0 and marks[c - 1])]
    return "".join(f"\\u{a:04x}-\\u{b - 1:04x}" for a, b in zip(edges[::2], edges[1::2], strict=True))


@lru_cache
def _patterns(pattern: str) -> tuple[re.Pattern, regex.Pattern]:
    """The pattern for texts up to U+FFFF, where a character class is a bitmap, and for all others."""
    letter, number = _ranges("L"), _ranges("N")
    plain, inside = pattern, False
    out, i = [], 0
    while i < len(plain):
        part = next((p for p in (r"\p{L}", r"\p{N}", r"\s", r"\S") if plain.startswith(p, i)), plain[i])
        inside = part == "[" or inside and part != "]"
        chars = {r"\p{L}": letter, r"\p{N}": number, r"\s": _SPACE}.get(part)
        out.append(f"[^{_SPACE}]" if part == r"\S" else part if chars is None else chars if inside else f"[{chars}]")
        i += len(part)
    return re.compile("".join(out)), regex.compile(pattern)


class Splitter:
    """Splits a text into its pre-tokens; a text is the concatenation of them."""

    def __init__(self, pattern: str):
        self.narrow, self.wide = (p.findall for p in _patterns(pattern))

    def __call__(self, text: str) -> list[str]:
        narrow = text.isascii() or len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text)
        return (self.narrow if narrow else self.wide)(text)


def byte_characters() -> str:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return "".join(chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256))


class _Remembered(dict):
    """Pre-token to its ids as bytes of ``kind``; of those not met for long, the older half is forgotten."""

    def __init__(self, encode, kind):
        super().__init__()
        self.encode, self.code, self.older = encode, kind.char, {}

    def __missing__(self, piece: str) -> bytes:
        value = self.older.get(piece)
        if value is None:
            ids = self.encode(piece)
            value = struct.pack(f"<{len(ids)}{self.code}", *ids)
        if len(piece) <= LONGEST:
            if len(self) >= CACHE:
                self.older = dict(self)
                self.clear()
            self[piece] = value
        return value


class PieceLengths(dict):
    """Ids of a pre-token by the ranks, remembered. Pre-tokens go to the library one by one: whole texts with very long
    runs of white space overflow the stack of its pattern engine."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        self.encode, self.split = ranked(path, pattern)._encode_single_piece, Splitter(pattern)

    def __missing__(self, piece: str) -> int:
        value = len(self.encode(piece.encode()))
        if len(piece) <= LONGEST:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = value
        return value

    def of(self, text: str | None) -> int:
        """Ids of a whole text."""
        return sum(map(self.__getitem__, self.split(text))) if text else 0


class LibraryEncoder:
    """Ids that the tokenizers library gives for whole texts with ``add_special_tokens=False``.

    For a byte-level BPE without normaliser, each pre-token is encoded by the library's model when it is first met and
    remembered; a text's ids are those of its pre-tokens. The file's added tokens are cut out before, as the library does.
    Other vocabularies, and those whose added tokens have conditions, encode whole texts.
    """

    def __init__(self, path: str, pattern: str):
        self.library = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        level, model, added = made.get("pre_tokenizer") or {}, made["model"], made.get("added_tokens") or []
        simple = not any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
        self.by_piece = simple and made.get("normalizer") is None and level.get("type") == "ByteLevel" and level.get("use_regex", True) and not level.get("add_prefix_space") and model.get("type") == "BPE" and not model.get("dropout")
        if self.by_piece:
            shown, model = byte_characters(), self.library.model
            self.split = Splitter(pattern)
            self.added = {t["content"]: np.array([t["id"]], self.kind).tobytes() for t in added if t["content"]}
            self.cut = re.compile("|".join(map(re.escape, sorted(self.added, key=lambda x: (-len(x), x))))) if self.added else None
            self.pieces = _Remembered(lambda x: [t.id for t in model.tokenize(x.encode().decode("latin-1").translate(shown))], self.kind)

    def __call__(self, text: str) -> bytes:
        """The ids, as little-endian numbers of ``kind``."""
        if not self.by_piece:
            return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
        if self.cut is None or not self.cut.search(text):
            return b"".join(map(self.pieces.__getitem__, self.split(text)))
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [*map(self.pieces.__getitem__, self.split(text[at : m.start()])), self.added[m[0]]]
            at = m.end()
        return b"".join([*out, *map(self.pieces.__getitem__, self.split(text[at:]))])


@lru_cache
def library_encoder(path: str, pattern: str) -> LibraryEncoder:
    """One encoder a worker process: what it remembers serves all tasks of the process."""
    return LibraryEncoder(path, pattern)


@lru_cache
def ranked(path: str, pattern: str) -> tiktoken.Encoding:
    """The tiktoken encoding of a rank file, without special tokens."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("ranked", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
