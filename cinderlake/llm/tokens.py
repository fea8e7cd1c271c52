"""Token ids of whole texts from public tokenizer files, in tasks.

A tokenizer that drops white space encodes the parts between white space one by
one, so a distinct part is encoded once and kept; text is then a matter of
splitting and joining.  What a worker keeps is bounded in bytes: at the bound what it
used lately becomes the older half, which is asked before a part is encoded anew and
then dropped; long parts are never kept.  Where the file's rules are the usual ones (lower case, one
pattern that cuts words, byte letters), a new part of Latin letters is cut by that
pattern and its words go to the file's model; any other part is encoded as a whole.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array

import regex

#: Bytes of parts and ids, about, that either half of a worker's store holds.
KEEP = 80 << 20
#: Longer parts, in characters, aren't kept.
LONG = 256
#: Bytes that a kept part takes beside its characters and ids, about.
_ENTRY = 220
#: Separators for str.split that are no white space to the tokenizer's own rule.
_ODD = re.compile("[\x1c-\x1f]")
_loaded: dict[str, SpacedTokens] = {}


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class SpacedTokens(dict):
    """Parts to ids, for a tokenizer that drops white space.  Ids are little-endian unsigned 32-bit, as bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        self.cut = self._pattern(rules)
        self.tokenize = self.tokenizer.model.tokenize
        self.marks = [t["content"] for t in rules["added_tokens"]]
        self.letters = _byte_letters()
        self.words: dict[str, bytes] = {}
        self.held = 0
        self.older: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})

    @staticmethod
    def _pattern(rules: dict):
        """What cuts lower-cased text into words, or None for a file of other rules."""
        steps = [n["type"] for n in (rules.get("normalizer") or {}).get("normalizers", [])]
        parts = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])
        usual = (
            steps == ["NFC", "Replace", "Lowercase"]
            and [p["type"] for p in parts] == ["Split", "ByteLevel"]
            and (parts[0]["behavior"], parts[0]["invert"]) == ("Removed", True)
            and not (parts[1]["add_prefix_space"] or parts[1]["use_regex"])
            and rules["model"]["type"] == "BPE"
            and not rules["post_processor"]
            and not any(t["content"].isalpha() for t in rules["added_tokens"])
        )
        return regex.compile(parts[0]["pattern"]["Regex"]) if usual else None

    @classmethod
    def at(cls, path: str) -> SpacedTokens:
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _keep(self, where: dict[str, bytes], part: str, ids: bytes) -> None:
        if len(part) > LONG:
            return
        self.held += _ENTRY + len(part) + len(ids)
        if self.held > KEEP:
            self.older = (dict(self), dict(self.words))
            self.clear()
            self.words.clear()
            self.held = 0
        where[part] = ids

    def _encoded(self, word: str) -> bytes:
        """What the model makes of one word of the pattern."""
        spelt = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.letters)
        return _packed([t.id for t in self.tokenize(spelt)])

    def _word(self, word: str) -> bytes:
        """Words of other characters than letters, which as parts may have other rules."""
        found = self.words.get(word)
        if found is None:
            found = self.older[1].get(word)
            if found is None:
                found = self._encoded(word)
            self._keep(self.words, word, found)
        return found

    def __missing__(self, part: str) -> bytes:
        ids = self.older[0].get(part)
        if ids is not None:
            self._keep(self, part, ids)
            return ids
        # Below U+0130 no normal form changes a letter, and each has one lower-case form.
        low = part.lower()
        if self.cut is None or max(part) >= "İ":
            ids = self.whole(part)
        elif low.isalpha():
            ids = self._encoded(low) if low == part else self[low]
        elif any(m in part for m in self.marks):
            ids = self.whole(part)
        else:
            ids = b"".join([self[w] if w.isalpha() else self._word(w) for w in self.cut.findall(low)])
        self._keep(self, part, ids)
        return ids

    def ids(self, text: str) -> bytes:
        return self.whole(text) if _ODD.search(text) else b"".join(map(self.__getitem__, text.split()))

    def batch(self, texts: list[str]) -> list[bytes]:
        return [self.ids(t) for t in texts]
