"""Token ids of texts by a public tokenizer file."""

from __future__ import annotations

import json
import os
import re

#: Runs of white space of this length are beyond the faster encoder's pattern matching.
_LONG_SPACE = re.compile(r"\s{1000}")


def _ranks(tokenizer) -> dict[bytes, int] | None:
    """The vocabulary as merge ranks, if merging by rank gives the tokenizer's own ids; None if not.

    It does for a byte-level vocabulary whose ids follow its merges and whose every entry is
    encoded as itself: two neighbours that join to an entry are then always the entry's own
    merge, since what lies between two boundaries is merged as if it stood alone.
    """
    from tokenizers.pre_tokenizers import ByteLevel

    spec = json.loads(tokenizer.to_str())
    model, cut = spec["model"], spec["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and spec["normalizer"] is None and not any(
        model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    )
    if not plain or cut.get("type") != "ByteLevel" or not cut["use_regex"] or cut["add_prefix_space"]:
        return None
    vocab = model["vocab"]
    merged = [vocab["".join(m)] for m in model["merges"]]
    if merged != sorted(set(merged)) or any([t.id for t in tokenizer.model.tokenize(entry)] != [i] for entry, i in vocab.items()):
        return None
    shown = set(ByteLevel.alphabet())
    hidden = [b for b in range(256) if chr(b) not in shown]
    byte_of = {chr(b): b for b in range(256) if chr(b) in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}
    return {bytes(map(byte_of.__getitem__, entry)): i for entry, i in vocab.items() if set(entry) <= shown}


class Ids:
    """ids(texts): for each text its token ids as little-endian unsigned 16-bit numbers.

    Texts are encoded whole by tiktoken, with the file's vocabulary as ranks, at a quarter of the
    time that tokenizers takes for the same ids. tokenizers itself encodes texts that hold an
    added token or a very long run of white space, and all texts where ranks would not do.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("token ids must fit 16 bits")
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ranks = _ranks(self.tokenizer)
        self.by_rank = ranks and tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _whole(self, text: str) -> bool:
        return self.by_rank is None or any(a in text for a in self.added) or _LONG_SPACE.search(text) is not None

    def ids(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        whole = [i for i, t in enumerate(texts) if self._whole(t)]
        own = dict(zip(whole, self.tokenizer.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False)))
        return [np.array(own[i].ids if i in own else self.by_rank.encode_ordinary(t), dtype="<u2").tobytes() for i, t in enumerate(texts)]


_LOADED: dict[str, Ids] = {}


def loaded(path: str) -> Ids:
    """The worker's own instance, kept from task to task."""
    if path not in _LOADED:
        _LOADED[path] = Ids(path)
    return _LOADED[path]
