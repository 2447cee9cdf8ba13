"""Cutting a text into pre-tokens exactly as the tokenizer libraries do, and the memo of their tokens.

The libraries carry their own Unicode tables.  The ``regex`` module agrees with them on the
characters in SAFE (compared character by character, see tests/llm/test_tokens.py); of a text with
other characters only the stretches between white space that hold one are handed to the library, so
results never depend on that agreement.
"""

from __future__ import annotations

import functools
import os
import re
import unicodedata

import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Characters on which the regex module and the libraries agree: up to Latin Extended-B, general
#: punctuation, currency signs, kana and the common Han block.
SAFE = r"\x00-ɏ‐-⁞₠-₿ぁ-ゖ゠-ヿ一-龥"
EXOTIC = regex.compile(f"[^{SAFE}]")
#: Characters that some version of Unicode or some library has as white space, or that are near such.
MAYBE_SPACE = r"\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff"
#: Where every split here ends a pre-token: white space after a character that no version of Unicode has as white space.
#: No pre-token goes on from one to the other, and no rule looks back, so what follows is cut as a text of its own.
STRETCH = regex.compile(r"[ \t\n\r]*+(?:[^ \t\n\r]|(?<=[\s" + MAYBE_SPACE + r"])[ \t\n\r])*+")
#: Pieces longer than this are encoded each time and not remembered.
MEMO_CHARS = 64
#: Remembered pieces of one Python worker, some 200 bytes each.
MEMO_PIECES = 250_000

#: Fixed value: the split of the word-end vocabulary, as its tokenizer file states it.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""


def exotic(text: str) -> bool:
    return not text.isascii() and EXOTIC.search(text) is not None


@functools.cache
def _spelled_out(kind: str) -> str:
    """The safe characters of a kind such as \\p{L}, as ranges for a character class."""
    of, ranges = regex.compile(kind), []
    for c in range(0x10000):
        if of.match(chr(c)) and not EXOTIC.match(chr(c)):
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in ranges)


@functools.cache
def compiled(pattern: str) -> re.Pattern:
    """A pattern for texts that are not exotic: letters, numbers and white space are spelled out, which the plain re module scans twice as fast as properties."""
    kinds = {k: _spelled_out(k) for k in (r"\p{L}", r"\p{N}", r"\s")}

    def in_class(m: re.Match) -> str:
        return functools.reduce(lambda t, k: t.replace(k, kinds[k]), kinds, m.group())

    out = re.sub(r"\[[^\]]*\]", in_class, pattern)
    for k, ranges in kinds.items():
        out = out.replace(k, f"[{ranges}]")
    return re.compile(out.replace(r"\S", "[^" + kinds[r"\s"] + "]"))


def pretokens(text: str, find) -> list[str]:
    """What a text is encoded by: the pre-tokens that `find` (of a compiled split) gives, and each stretch with an exotic character in one piece, for the library to cut."""
    if not exotic(text):
        return find(text)
    out: list[str] = []
    for stretch in STRETCH.findall(text):
        out += [stretch] if exotic(stretch) else find(stretch)
    return out


@functools.cache
def byte_of_char() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary: printable Latin-1 is itself, others follow from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@functools.cache
def _char_of_byte() -> list[str]:
    shown = {b: c for c, b in byte_of_char().items()}
    return [shown[b] for b in range(256)]


def as_shown(piece: str) -> str:
    """A pre-token in the characters of a byte-level vocabulary."""
    chars = _char_of_byte()
    return "".join([chars[b] for b in piece.encode()])


class Memo(dict):
    """Values of pre-tokens; a missing one is computed, and kept if it is short.

    Beyond what is known at the start it holds MEMO_PIECES at most, in two generations: when the young
    one is full it becomes the old one, and pieces used again are taken over from there.
    """

    def __init__(self, value, known: dict | None = None):
        super().__init__(known or {})
        self.value, self.known, self.old, self.room = value, known or {}, {}, MEMO_PIECES // 2

    def __missing__(self, piece: str):
        out = self.old.get(piece)
        if out is None:
            out = self.value(piece)
        if len(piece) <= MEMO_CHARS:
            if self.room <= 0:
                self.old = dict(self)
                self.clear()
                self.update(self.known)
                self.room = MEMO_PIECES // 2
            self[piece] = out
            self.room -= 1
        return out


def lowered(text: str) -> str:
    """The normal form of the word-end vocabulary, NFC in lower case; its runs of white space need no merging, as the split drops them.  Only for texts that are not exotic."""
    return (text if text.isascii() else unicodedata.normalize("NFC", text)).lower()
