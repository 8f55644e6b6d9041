"""Ids of a lower-casing word tokenizer, with every distinct run between white space encoded once per task.

The file's split pattern makes words that never hold white space; a word's ids do not depend on its
neighbours. Texts of plain Latin letters are lowered and split here, where that is known to equal the
library's work; any other text (combining marks, other scripts, unusual white space, special strings)
goes through the library whole.
"""

from __future__ import annotations

import re
import struct
import unicodedata

from .tokenizer_file import TokenizerFile, special_strings

CACHE_PARTS = 300_000  # runs in each of the two tables that a task remembers
CACHED_CHARS = 64
PLAIN_END = 0x180  # below: no combining marks, nothing that NFC changes, lower case letter by letter
# fixed values: the settings of the file that the short cut is written for
NORMALIZERS = ("NFC", "Replace", "Lowercase")
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def plain_classes() -> tuple[str, str]:
    """Letters and numbers below ``PLAIN_END`` as character classes."""

    def ranges(kind: str) -> str:
        points = [i for i in range(PLAIN_END) if unicodedata.category(chr(i))[0] == kind]
        out, start = [], points[0]
        for a, b in zip(points, [*points[1:], None]):
            if b != a + 1:
                out.append(f"\\u{start:04x}-\\u{a:04x}")
                start = b
        return "".join(out)

    return ranges("L"), ranges("N")


class Lately:
    """What was met lately, in two tables: when the newer is full it becomes the older, which is forgotten."""

    def __init__(self, size: int):
        self.size, self.new, self.old = size, {}, {}

    def unknown(self, keys: set) -> list:
        """Keys that neither table has; what the older has is moved to the newer."""
        out = []
        for key in keys:
            value = self.old.get(key)
            if value is None:
                out.append(key)
            else:
                self.new[key] = value
        return out

    def add(self, found: dict, longest: int) -> None:
        if len(self.new) + len(found) > self.size:
            self.old, self.new = self.new, {}
        self.new.update((k, v) for k, v in found.items() if len(k) <= longest)


class WordCoder:
    def __init__(self, file: TokenizerFile):
        spec = file.spec()
        steps = (spec["normalizer"] or {}).get("normalizers", [])
        split = spec["pre_tokenizer"].get("pretokenizers", [{}])[0]
        self.special = special_strings(spec)
        self.tokenizer = file.open()
        known = tuple(s["type"] for s in steps) == NORMALIZERS and split.get("pattern", {}).get("Regex") == SPLIT
        letters, numbers = plain_classes()
        # U+0130 lowers to two characters; U+001C to U+001F, U+0085 and U+00A0 are white space for some only
        odd = f"[^\\x00-\\x1b\\x20-\\x84\\x86-\\x9f\\xa1-\\u012f\\u0131-\\u{PLAIN_END - 1:04x}]"
        self.unusual = re.compile(odd if known else "")
        self.words = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{letters}]+|[{numbers}]|[^\\s{letters}{numbers}]+")
        self.cache = Lately(CACHE_PARTS)

    def encode(self, text: str) -> bytes:
        """Ids end to end, each as four bytes, lowest first."""
        if not text:
            return b""
        if self.unusual.search(text) or any(s in text for s in self.special):
            return pack(self.tokenizer.encode(text, add_special_tokens=False).ids)
        parts = text.lower().split()
        found = list(map(self.cache.new.get, parts))
        if None in found:
            missing = [i for i, ids in enumerate(found) if ids is None]
            fresh = self.encode_new(self.cache.unknown({parts[i] for i in missing}))
            known = self.cache.new
            for i in missing:
                found[i] = fresh[parts[i]] if parts[i] in fresh else known[parts[i]]
            self.cache.add(fresh, CACHED_CHARS)
        return b"".join(found)

    def encode_new(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of parts by the library's merges, which see a word as one letter for each of its bytes."""
        merge, words, out = self.tokenizer.model.tokenize, self.words.findall, {}
        for part in parts:
            ids = [t.id for w in words(part) for t in merge(w if w.isascii() and w.isprintable() else spelled(w))]
            out[part] = pack(ids)
        return out


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable bytes stand for themselves."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


_letters = byte_letters()


def spelled(text: str) -> str:
    return "".join([_letters[b] for b in text.encode()])


def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


_coders: dict[str, WordCoder] = {}


def word_coder(file: TokenizerFile) -> WordCoder:
    if file.version not in _coders:
        _coders[file.version] = WordCoder(file)
    return _coders[file.version]
