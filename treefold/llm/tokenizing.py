"""Token ids by the tokenizers library, with every distinct word encoded once per worker.

Both vocabularies split a text before they merge anything, so a text's ids are those of its space-separated parts put
together. A worker remembers the ids of parts (as packed little-endian uint32) and of the pieces inside parts; only
unseen pieces reach the library's BPE model. Whatever the split cannot be proven for (runs of white space, letters
outside Latin) goes through the library's full encoder instead. Added tokens that a text spells out (such as
<|endoftext|>) get their own ids, as the library gives them; the text between them is encoded stretch by stretch.

Memory is bounded: parts above LONG characters are not remembered, and a memo that has used up half of its bytes becomes
the old generation of a new one, so that frequent words stay known and rare ones are forgotten.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata

import numpy as np
import regex

#: The white space of the library's patterns: fixed values of the Unicode property White_Space.
SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"
#: The last code point of Latin Extended-B; beyond it the word vocabulary's own normaliser decides.
LATIN_END = "ɏ"
#: Parts above this many characters are rarely met again and are not remembered.
LONG = 64
#: Signs that are a piece of their own behind a word.
STOPS = frozenset(".,;:!?)")
PACK = [struct.Struct(f"<{n}I").pack for n in range(24)]
#: About what an entry of a memo takes beside its key and its ids.
ENTRY_BYTES = 120


def vocabulary(name: str) -> str:
    """Path of a vocabulary file of the public_tokenizers package on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies write bytes: printable ones as they are, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """encode(text) gives the ids as bytes (uint32, little-endian); equal to the library's encode(text, add_special_tokens=False)."""

    def __init__(self, path: str, memo_bytes: int = 192 << 20, stretch: int = 1 << 20):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.lower = spec["normalizer"] is not None  # the word vocabulary normalises and drops white space
        self.model = self.full.model
        self.model._resize_cache(0)  # the memos take its place; it would only be searched in vain
        self.letters = _byte_letters()
        if self.lower:
            self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        else:
            self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        self.most, self.stretch = memo_bytes, stretch
        self.parts = _Memo(self._part)
        self.seen = _Memo(self._merge)
        self.spaces = re.compile(f"[{SPACE}]+")
        self.odd = re.compile("[\x1c-\x1f]").search
        self.added = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in spec["added_tokens"]}
        # Tokens that also take in what stands beside them, or that are met after normalising, are left to the library.
        self.plain_added = not any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        self.at_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split

    def encode(self, text: str) -> bytes:
        if self.parts.size + self.seen.size > self.most // 2:  # the other half is the old generation's
            self.parts.age()
            self.seen.age()
        if any(t in text for t in self.added):
            if not self.plain_added:
                return self._whole(text)
            return b"".join(self.added[s] if i % 2 else self._between(s) for i, s in enumerate(self.at_added(text)))
        return self._between(text)

    def _between(self, text: str) -> bytes:
        """Ids of a text without added tokens."""
        if self.lower:
            # str.split() also splits at four control characters, which the library takes for symbols.
            odd = self.odd(text)
            out, at = [], 0
            while at < len(text):  # one stretch, but for very long texts
                cut = self._cut(text, at + self.stretch) if len(text) - at > self.stretch else len(text)
                part = text[at:cut]
                out.append(b"".join(map(self.parts.__getitem__, self.spaces.split(part) if odd else part.split())))
                at = cut
            return b"".join(out)
        if len(text) <= self.stretch:
            return self._run(text, True)
        out, at, first = [], 0, True
        while at < len(text):
            cut = self._cut(text, at + self.stretch)
            out.append(self._run(text[at:cut], first))
            at, first = cut + 1, False  # the space at the cut belongs to the word after it
        return b"".join(out)

    def _cut(self, text: str, at: int) -> int:
        """The next single space between two words, where a text can be cut; its end if there is none."""
        while (at := text.find(" ", at)) >= 0:
            if at + 1 < len(text) and text[at - 1] not in SPACE and text[at + 1] not in SPACE:
                return at
            at += 1
        return len(text)

    def _run(self, text: str, first: bool) -> bytes:
        """Ids of a text, or of its part from a space on (which the part does not repeat)."""
        head, *rest = text.split(" ") if first else ("", *text.split(" "))
        whole = text if first else " " + text
        if first and (not rest or not head or head[-1] in SPACE or self.odd(head)):
            return self._whole(whole)  # white space at the very start may run on into the next part
        try:
            return b"".join(map(self._piece, self.pieces(head))) + b"".join(map(self.parts.__getitem__, rest))
        except TypeError:  # a None: some run of white space makes its parts depend on each other
            return self._whole(whole)

    def _whole(self, text: str) -> bytes:
        return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes() if text else b""

    def _part(self, w: str) -> bytes | None:
        """Ids of one part between spaces; None if it starts a run of white space."""
        latin = w.isascii() or max(w) <= LATIN_END
        if self.lower:
            if not w:
                return b""
            if not latin or not (w.isascii() or unicodedata.is_normalized("NFC", w)):
                return self._whole(w)
            w = w.lower()
        elif not w or w[0] in SPACE:
            return None
        if latin and w.isalpha():
            return self._merge(w if self.lower else " " + w)
        if latin and w[-1] in STOPS and w[:-1].isalpha():  # two pieces
            return self.parts[w[:-1]] + self.seen[w[-1]]
        if not self.lower:
            if self.odd(w):
                return self._whole(" " + w)
            before, line_end, after = w.partition("\n")
            if after and after[0] not in SPACE and before[-1] not in SPACE:  # a lone line end is a piece of its own
                rest = self.seen[after] if latin and after.isalpha() else b"".join(map(self._piece, self.pieces(after)))
                return self.parts[before] + self.seen[line_end] + rest
        return b"".join(map(self._piece, self.pieces(w if self.lower else " " + w)))

    def _piece(self, p: str) -> bytes:
        """Ids of one piece: known as a part of its own, known as a piece, or new."""
        got = self.parts.known(p if self.lower else p[1:] if p[0] == " " else "")
        return self.seen[p] if got is None else got

    def _merge(self, p: str) -> bytes:
        word = p.replace(" ", self.letters[32]) if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(word)]
        return PACK[len(ids)](*ids) if len(ids) < len(PACK) else np.array(ids, "<u4").tobytes()


class _Memo(dict):
    """Works out what it does not hold yet, and counts the bytes of what it remembers.

    age() makes it the old generation and starts a new one; what is met again moves over, the rest goes at the next age().
    """

    def __init__(self, make):
        super().__init__()
        self.make, self.size, self.old = make, 0, {}

    def __missing__(self, key):
        got = self.old.get(key, self)
        if got is self:
            got = self.make(key)
        if len(key) <= LONG:
            self[key] = got
            self.size += ENTRY_BYTES + 2 * len(key) + len(got or b"")
        return got

    def known(self, key):
        """What is remembered of key in either generation, or None."""
        got = self.get(key)
        return self.old.get(key) if got is None else got

    def age(self):
        self.old = dict(self)
        self.clear()
        self.size = 0


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per vocabulary file and worker process; its memo lives as long as the worker."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
