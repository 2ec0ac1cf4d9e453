"""Splits texts into the pre-tokens of a byte-level vocabulary file, and knows each distinct pre-token's ids."""

from __future__ import annotations

import json
import os
import re
from itertools import islice

import numpy as np

#: The pattern of byte-level vocabularies of this kind; white space is Unicode's White_Space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

#: The same for texts of ASCII and Latin letters alone, in a form that Python's own engine matches faster.
LATIN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[a-zA-ZÀ-ÖØ-öø-ɏ]+| ?[0-9]+| ?[!-/:-@\[-`{-~]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
ONLY_LATIN = r"[\t-\r -~À-ÖØ-öø-ɏ]*"

#: Pre-tokens a worker remembers at once; beyond, it forgets all but the earliest, which are the frequent ones. Results do not depend on it.
REMEMBERED, KEPT = 600_000, 200_000

_LOADED: dict[str, Pretokens] = {}
_KNOWN: dict[tuple, dict] = {}


class Pretokens:
    """Of one byte-level .json file of the tokenizers library, loaded once a worker."""

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pre = spec["pre_tokenizer"] or {}
        if pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or spec["normalizer"]:
            raise ValueError("the vocabulary is not a plain byte-level one")
        self.any, self.latin, self.only_latin = regex.compile(PATTERN).findall, re.compile(LATIN).findall, re.compile(ONLY_LATIN).fullmatch
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.at_special = regex.compile("|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)

    def parts(self, text: str):
        """(stretch, special id or None): special strings are tokens of their own, as the library takes them."""
        at = 0
        for hit in self.at_special.finditer(text) if self.at_special else ():
            if hit.start() > at:
                yield text[at : hit.start()], None
            yield hit.group(), self.special[hit.group()]
            at = hit.end()
        if at < len(text) or not text:
            yield text[at:], None

    def split(self, text: str) -> list[str]:
        return self.latin(text) if self.only_latin(text) else self.any(text)

    def pretokens(self, text: str) -> list[str]:
        if not self.special or not any(x in text for x in self.special):
            return self.split(text)
        return [x for part, special in self.parts(text) for x in ([part] if special is not None else self.split(part))]

    def ids_of(self, distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the distinct pre-tokens one after the other, and where each one's begin, with the end."""
        whole = self.tokenizer.encode(distinct, is_pretokenized=True, add_special_tokens=False)
        sizes = np.bincount(np.array(whole.word_ids, np.int64), minlength=len(distinct))
        return np.array(whole.ids, "<u4"), np.concatenate([[0], np.cumsum(sizes)])


def loaded(path: str) -> Pretokens:
    if path not in _LOADED:
        _LOADED[path] = Pretokens(path)
    return _LOADED[path]


class Remembered:
    """A worker's table of distinct pre-tokens: the value of each, made once from what the library gives."""

    def __init__(self, path: str, values) -> None:
        """values: from the ids of distinct pre-tokens and their starts to a list with each one's value."""
        self.pre, self.values = loaded(path), values
        self.known = _KNOWN.setdefault((path, values), {})

    def of(self, pretokens: list[str]) -> list:
        known = self.known
        try:
            return [known[x] for x in pretokens]
        except KeyError:
            new = list({x for x in pretokens if x not in known})
            known.update(zip(new, self.values(*self.pre.ids_of(new)), strict=True))
            out = [known[x] for x in pretokens]
            if len(known) > REMEMBERED:
                frequent = list(islice(known.items(), KEPT))
                known.clear()
                known.update(frequent)
            return out


def counted(ids: np.ndarray, starts: np.ndarray) -> list[int]:
    return np.diff(starts).tolist()


def packed(ids: np.ndarray, starts: np.ndarray) -> list[bytes]:
    data, at = ids.tobytes(), (4 * starts).tolist()
    return [data[a:b] for a, b in zip(at, at[1:], strict=False)]
