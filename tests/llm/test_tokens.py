import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.tokens import loaded

BYTES = loaded(public_tokenizers.path("byte_bpe_50k.json"))


def same(texts):
    want = [e.ids for e in BYTES.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, dtype="<u2").tolist() for x in BYTES.ids(texts)] == want


def test_merging_by_rank_is_used():
    assert BYTES.by_rank is not None


def test_every_character_in_several_places():
    chars = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c <= 0xDFFF]
    for at in range(0, len(chars), 500):
        some = chars[at : at + 500]
        same(["\n".join(f"a{c}b  {c} 1{c}{c}'s" for c in some)])


def test_long_runs_and_added_tokens():
    same([" " * 200_000, "a" + "\n" * 200_000 + "b", "ab" * 100_000, "#" * 100_000, "x <|endoftext|> y", "", " ", "  a  "])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=80) | st.text("ab cé'sŁ1\n\t  #.", max_size=60), max_size=8))
def test_random_texts(texts):
    same(texts)


def test_other_tokenizers_encode_by_themselves():
    other = loaded(public_tokenizers.path("word_bpe_49k.json"))
    assert other.by_rank is None
    want = other.tokenizer.encode("Some Words here", add_special_tokens=False).ids
    assert np.frombuffer(other.ids(["Some Words here"])[0], dtype="<u2").tolist() == want
