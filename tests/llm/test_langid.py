import math

import numpy as np
import pandas as pd
import pytest

from tests.llm.helpers import awkward
from tidemark.llm import langid as l
from tidemark.llm.common import table


def grams(words):
    n = {}
    for w in words:
        p = f"{l.PAD}{w} "
        for i in range(len(w) + 1):
            n[p[i : i + l.ORDER]] = n.get(p[i : i + l.ORDER], 0) + 1
    return n


def plain(words):
    """Interpolated Kneser-Ney by dictionaries and recursion."""
    counts = {l.ORDER: grams(words)}
    for k in range(l.ORDER - 1, 0, -1):
        c = {}
        for g, n in counts[k + 1].items():
            c[g[1:]] = c.get(g[1:], 0) + (n if g[1] == " " and k > 1 else 1)
        counts[k] = c
    d = {}
    for k, c in counts.items():
        one, two = sum(n == 1 for n in c.values()), sum(n == 2 for n in c.values())
        d[k] = one / (one + 2 * two) if one and two else 0.5

    def p(gram):
        k = len(gram)
        if not k:
            return 1 / 256
        same = [n for g, n in counts[k].items() if g[:-1] == gram[:-1]]
        if not same:
            return p(gram[1:])
        own = counts[k].get(gram)
        return ((own - d[k]) / sum(same) if own else 0) + d[k] * len(same) / sum(same) * p(gram[1:])

    return p


WORDS = {"aa": ["hello", "help", "hell", "held", "yellow", "the", "the", "then", "a"], "bb": ["hola", "que", "queso", "la", "la", "ella", "ñu"]}


@pytest.fixture(scope="module")
def model():
    return l.Model(pd.DataFrame([(lang, g, n) for lang, w in WORDS.items() for g, n in grams(w).items()], columns=["lang", "gram", "n"]))


def test_matches_recursion(model):
    tried = ["hello", "quello", "zzz", "ña", "t"]
    got = model.words(tried)
    for j, lang in enumerate(model.langs):
        p = plain(WORDS[lang])
        for i, w in enumerate(tried):
            padded = f"{l.PAD}{w} "
            want = sum(math.log(p(padded[k : k + l.ORDER])) for k in range(len(w) + 1))
            assert abs(got[i, j] - want) < 1e-3 * abs(want)


def test_probabilities_sum_to_one():
    p = plain(WORDS["aa"])
    seen = sum(p("   h" + c) for c in "abcdefghijklmnopqrstuvwxyz ")
    assert 0.85 < seen < 1.0 + 1e-9


def test_hash_arrays_are_sorted(model):
    for keys, _, contexts, _ in model.tables:
        assert (np.diff(keys.astype(float)) >= 0).all() and (np.diff(contexts.astype(float)) >= 0).all()


def test_held_out_accuracy(spark):
    d = table(spark, "/root/testdata/sf0.01", "documents")
    held = l.held_out(4, 2)
    r = l.predict(d, l.train(d.where(~held)), held).join(d.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert len(r) > 150 and sum(x.lang == x.lang_pred for x in r) >= 0.99 * len(r)
    assert all(0 <= x.score <= 1 for x in r)


def test_awkward_rows(spark):
    d = awkward(spark)
    r = l.predict(d, l.train(d), l.held_out(4, 2)).collect()
    by = {x.doc_id: x for x in r}
    assert len(r) == 10 and {by[i].lang_pred for i in (2, 3, 4)} == {"und"} and by[5].lang_pred == "en"
    assert all(x.lang_pred in ("en", "de", "und") and 0 <= x.score <= 1 for x in r)
    none = d.limit(0)
    assert l.predict(none, l.train(none), l.held_out(4, 2)).count() == 0
    assert {x.lang_pred for x in l.predict(d, l.train(none), l.held_out(4, 2)).collect()} == {"und"}


def test_rare_language_keeps_rejection(spark):
    d = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang")
    rare = spark.createDataFrame([(10**6 + i, "qua quo zzyx wyx qqua zzo " * 3, "zz") for i in range(5)], "doc_id long, text string, lang string")
    m = l.train(d.union(rare))
    assert "zz" in m.langs and np.isfinite(m.limit).all()
    noise = " ".join("".join(chr(97 + (i * i * 7 + j * j * 11 + i * j) % 26) for j in range(9)) for i in range(60))
    r = {x.doc_id: x for x in l.predict(d.union(rare).union(spark.createDataFrame([(-1, noise, None)], d.schema)), m, l.held_out(4, 2)).collect()}
    assert r[-1].rejected and r[10**6].lang_pred == "zz" and not r[10**6].rejected
    assert sum(x.rejected for x in r.values() if x.lang_pred != "und") < 0.03 * len(r)


def test_every_language_is_learned(spark):
    rows = [(100 * k + i, "".join(chr(0x4E00 + 20 * k + (i * 7 + j) % 15) for j in range(9)), f"l{k}") for k in range(130) for i in range(3)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = l.train(d)
    assert len(m.langs) == 130
    r = l.predict(d, m, l.held_out(4, 2)).join(d, "doc_id").collect()
    assert all(x.lang == x.lang_pred for x in r)


def test_number_characters_are_no_letters(model):
    got = l.Scorer(model).score(["½ " * 50, "½ " * 51, "½ " * 60 + "hello"])
    assert [g[0] for g in got] == ["und", "und", "aa"]
