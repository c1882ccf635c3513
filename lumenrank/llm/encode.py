"""Whole-text encoding with the public ``tokenizers`` files, memoised by pre-token.

Both vocabularies split a text into pre-tokens and run BPE inside each of them, so the ids of a text are
the ids of its pre-tokens in order.  A corpus repeats its pre-tokens, hence :class:`Encoder` lets the
``tokenizers`` library encode every *distinct* pre-token once per worker and joins the remembered ids.
Texts outside the alphabet for which the split is known to agree (see ``_PLAIN``), or which hold an added
token's string, are encoded whole by the library, and so is every text where the file normalises or splits in
another way than ``FORMS`` says; so the ids equal ``Tokenizer.encode(text,
add_special_tokens=False).ids`` for every text.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable

import numpy as np

#: Printable ASCII, tab, line feed, carriage return and the Latin letters to U+024F, without I with dot
#: above (its lower case is two characters): here NFC, lower case and the classes agree everywhere.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\u012f\u0131-\u024f]*")
#: Letters and digits of that alphabet, as character classes.
_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
#: The split patterns of the two vocabulary files, written for that alphabet (letters first: no
#: alternative that comes before them in the files can match where they do).
SPLITS = {
    "byte": f" ?[{_LETTER}]+| ?[{_NUMBER}]+|{_SHORT}| ?[^\\s{_LETTER}{_NUMBER}]+|\\s+(?!\\S)|\\s+",
    "word": f"[{_LETTER}]+|[{_NUMBER}]|{_SHORT}|[^\\s{_LETTER}{_NUMBER}]+",
}
#: The normalizer and pre-tokenizer of the files that ``SPLITS`` stands for.
FORMS = {
    "byte": (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}),
    "word": (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {"type": "Sequence", "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ]},
    ),
}
#: Distinct pre-tokens that a worker remembers before it starts afresh; bounds its memory, not its results.
MEMO = 250_000


def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level BPE writes for each byte: printable bytes stand for
    themselves, the others get the characters from U+0100 on, in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)}


class Memo(dict):
    """What ``make`` gives for each key, made when first asked for; starts afresh beyond ``most`` keys."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


class Encoder:
    """``encode(text)`` gives the text's ids as little-endian unsigned 16-bit bytes (both vocabularies fit).

    ``kind`` is ``byte`` (byte-level BPE) or ``word`` (lower-cased words).
    """

    def __init__(self, path: str, kind: str, most: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        if self.tok.get_vocab_size() > 1 << 16:
            raise ValueError("ids beyond 16 bits")
        self.kind, self.find, self.bpe = kind, re.compile(SPLITS[kind]).findall, self.tok.model.tokenize
        form = json.loads(self.tok.to_str())
        self.known = (form["normalizer"], form["pre_tokenizer"]) == FORMS[kind]
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.letters = _byte_letters()
        self.memo = Memo(self.part, most)

    def shown(self, part: str) -> str:
        if part.isascii() and part.isprintable():
            return part.replace(" ", self.letters[0x20])
        return part.encode().decode("latin-1").translate(self.letters)

    def part(self, part: str) -> bytes:
        return array("H", [t.id for t in self.bpe(self.shown(part))]).tobytes()

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.known or not _PLAIN.fullmatch(text) or ("<|" in text and any(a in text for a in self.added)):
            return self.whole(text)
        parts = self.find(text.lower() if self.kind == "word" else text)
        return b"".join(map(self.memo.__getitem__, parts))


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: str, most: int = MEMO) -> Encoder:
    """The worker's encoder of a vocabulary file, loaded once per Python worker."""
    if (path, kind) not in _ENCODERS:
        _ENCODERS[path, kind] = Encoder(path, kind, most)
    return _ENCODERS[path, kind]
