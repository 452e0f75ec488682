"""Token ids of texts by a tokenizer file whose words are encoded one by one, with a cache of words."""

from __future__ import annotations

import json
import os
import re

import numpy as np

#: Fixed value: the pre-tokenizer's pattern, as the file has it.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words that a worker keeps at most.
CACHE = 400_000

_LETTERS = "a-zA-ZªµºÀ-ÖØ-öø-įı-ſ"
_NUMBERS = "0-9²³¹¼-¾"
#: Texts of these characters alone are split here: tab, line feed, return, printable ASCII, Latin-1 and Latin Extended-A without the dotted I.
#: None of them changes under NFC, and each has the same class and lower case everywhere.
_PLAIN = re.compile("[\t\n\r\\x20-\\x7e¡-įı-ſ]*")
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+")


def _by_words(spec: dict) -> bool:
    """Whether the tokenizer lowers, splits by WORD_PATTERN and then encodes every word by itself."""
    normal, cut, model = spec["normalizer"] or {}, spec["pre_tokenizer"] or {}, spec["model"]
    kinds = [n["type"] for n in normal.get("normalizers", [])]
    steps = cut.get("pretokenizers", [{}])
    return (
        kinds == ["NFC", "Replace", "Lowercase"] and normal["normalizers"][1]["pattern"] == {"Regex": r"\s+"} and normal["normalizers"][1]["content"] == " "
        and [s.get("type") for s in steps] == ["Split", "ByteLevel"] and steps[0]["pattern"] == {"Regex": WORD_PATTERN} and steps[0]["behavior"] == "Removed" and steps[0]["invert"]
        and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"] and model["type"] == "BPE" and not model["dropout"]
    )


def _byte_letters() -> dict[int, str]:
    """Of every plain character the letters that stand for its UTF-8 bytes: a byte that can be shown as it is, the others from 256 on."""
    from tokenizers.pre_tokenizers import ByteLevel

    shown = {ord(c) for c in ByteLevel.alphabet() if ord(c) < 256}
    hidden = [b for b in range(256) if b not in shown]
    letter = {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(0x180)}


class WordIds:
    """ids(texts): for each text its token ids as little-endian unsigned 16-bit numbers, the same as tokenizers gives.

    Texts of plain characters are lowered and split here and their words looked up; a new word is encoded by tokenizers alone, which gives
    the ids that it has in any text. Other texts, those with an added token, and all texts of a tokenizer that works otherwise, go to tokenizers whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("token ids must fit 16 bits")
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_words = _by_words(json.loads(self.tokenizer.to_str()))
        self.model, self.bytes_of = self.tokenizer.model, _byte_letters()
        self.words: dict[str, bytes] = {}

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u2").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str) -> bytes:
        """A word as the pre-tokenizer hands it to the model: a letter for each of its bytes."""
        return np.array([t.id for t in self.model.tokenize(word.translate(self.bytes_of))], dtype="<u2").tobytes()

    def _plain(self, text: str) -> bool:
        return self.by_words and _PLAIN.fullmatch(text) is not None and not any(a in text for a in self.added)

    def ids(self, texts: list[str]) -> list[bytes]:
        split = [_WORDS.findall(t.lower()) if self._plain(t) else None for t in texts]
        whole = [i for i, s in enumerate(split) if s is None]
        own = dict(zip(whole, self._encoded([texts[i] for i in whole])))
        if len(self.words) > CACHE:
            self.words = {}
        known = self.words
        for w in {w for s in split if s is not None for w in s if w not in known}:
            known[w] = self._word(w)
        return [own[i] if s is None else b"".join([known[w] for w in s]) for i, s in enumerate(split)]


_LOADED: dict[str, WordIds] = {}


def loaded(path: str) -> WordIds:
    """The worker's own instance, kept from task to task."""
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]
