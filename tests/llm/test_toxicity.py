import pytest

from tests.llm.helpers import awkward
from tidemark.llm import toxicity as x
from tidemark.llm.common import table
from tidemark.llm.labelled import drawn, fold


@pytest.fixture(scope="module")
def scanner():
    return x.Scanner({"scum": 6.0}, {"lowei": 5.0})


def test_clauses(scanner):
    one = lambda t: scanner.document(t)[0]
    assert one("the weather is fine. nothing here") == 0
    assert one("what scum that is") == 6
    assert one("scumbag and discum") == 0
    assert one("you are scum") == 9
    assert one("he is not scum") == pytest.approx(6 * x.NEGATED)
    assert one("he said that it is scum") == pytest.approx(6 * x.TOLD)
    assert one("he said scum") == 6
    assert one("I will kill time") == 0
    assert one("they say you kill") == x.AIMED * x.SEED_WEIGHT
    assert one("ein loweienhaft und LOWEI.") == 10
    assert scanner.document("scum. fine. Scum!\nscum and scum")[1] == 3
    assert scanner.document(None) == scanner.document("") == (0.0, 0)


def test_composition_is_associative():
    a, b, c, d = x.Near("y", "it", 4, 1.5, only="t"), x.Weighted("a", 1.5), x.Near("n", "it", 2, 0.5), x.Reported()
    left, right = ((a >> b) >> c) >> d, a >> (b >> (c >> d))
    import itertools

    for labels in itertools.product("ityrnqo", repeat=5):
        out = []
        for m in (left, right):
            s, got = m.start, []
            for z in labels:
                s, o, f = m.step(s, z)
                got.append((o, f))
            out.append(got)
        assert out[0] == out[1]


def test_learns_words_and_beginnings(spark):
    rows = []
    for i in range(120):
        base = [f"{chr(97 + j % 26)}word{chr(97 + j // 26)}" for j in range(i % 17, i % 17 + 12)]
        if i % 6 == 0:
            base[3:3] = ["scumbag"]
            base[7:7] = [f"lowei{'abcdefgh'[i // 6 % 8]}x"]
        rows.append((i, " ".join(base), int(i % 6 == 0)))
    words, beginnings = x.entries_of(spark.createDataFrame(rows, "doc_id long, text string, y int"))
    assert set(words) == {"scumbag"} and set(beginnings) == {"lowei"}


def test_held_out(spark):
    d, lab = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    m = x.model_for(d, lab)
    r = x.predict(d, m, fold(5))
    assert r.count() == 1000
    r = r.where("held_out").join(lab, "doc_id").collect()
    assert sum(z.predicted for z in r if z.toxic == 0) == 0
    assert sum(z.predicted for z in r if z.toxic == 1) >= 0.6 * sum(z.toxic for z in r)  # of six labels; README has those of the large table
    assert x.clean(d, m).columns == d.columns


def test_awkward_rows(spark):
    d = awkward(spark)
    lab = spark.createDataFrame([(1, 1), (5, 0), (3, 1), (None, 1), (8, None)], "doc_id long, toxic int")
    for labels in (lab, lab.limit(0)):
        m = x.train(drawn(d, labels, "toxic", 100, fold(5) | ~fold(5)))
        r = x.predict(d, m, fold(5)).collect()
        assert len(r) == 10 and all(0 <= z.score <= 1 and z.predicted == 0 for z in r if z.doc_id != 1)
        assert x.clean(d, m).schema == d.schema and x.clean(d.limit(0), m).count() == 0


def test_threats_before_their_target(scanner):
    one = lambda t: scanner.document(t)[0]
    assert one("I will kill you") == one("destroy them") == one("we hurt all of you") == x.AIMED * x.SEED_WEIGHT
    assert one("I will not kill you") == pytest.approx(x.NEGATED * x.AIMED * x.SEED_WEIGHT)
    assert one("kill time and then wait for you") == one("kill time. you wait") == 0


def test_learned_words_of_the_fixed_lists():
    s = x.Scanner({"kill": 5.0, "they": 4.0, "nie": 6.0, "idiot": 1.0}, {})
    one = lambda t: s.document(t)[0]
    assert one("kill time") == 5 and one("kill you") == 5 * x.AIMED
    assert one("they came") == 4 and one("they came, idiot") == 4 + x.AIMED * x.SEED_WEIGHT
    assert one("nie idiot") == pytest.approx(6 + x.NEGATED * x.SEED_WEIGHT)


def test_learns_short_words_and_fixed_frames(spark):
    word = lambda k: f"{chr(97 + k % 26)}word{chr(97 + k // 26 % 26)}"
    rows = [(i, " ".join([word(i // 6 * 7 + j * (i % 5 + 1)) for j in range(12)] + (["you", "twerpish", "du", "zob"] if i % 6 == 0 else ["you", "du"])), int(i % 6 == 0)) for i in range(240)]
    copied = [(1000 + i, " ".join(["only", "in", "copies"] + [word(j) for j in range(12)] + ["end" + chr(97 + i)]), 1) for i in range(12)]
    words, _ = x.entries_of(spark.createDataFrame(rows + copied, "doc_id long, text string, y int"))
    assert set(words) == {"twerpish", "zob"}


def plain_score(labels, weights):
    """A clause's score said word by word, without machines: distances to the words around."""
    score, near = 0.0, lambda k, kind, reach: any(labels[j] == kind for j in range(max(0, k - reach), k))
    told_from = len(labels)
    for j, label in enumerate(labels):
        if label == "q":
            k = j - 1
            while k >= 0 and labels[k] == "q":
                k -= 1
            if k >= 0 and labels[k] == "r":
                told_from = j
                break
    for k, label in enumerate(labels):
        if label not in "it":
            continue
        aimed = label == "t" and any(labels[j] == "y" for j in range(k + 1, min(len(labels), k + 5)))
        after = near(k, "y", 4)
        if label == "t" and not aimed and not after:
            continue
        factor = x.AIMED if aimed or after else 1.0
        factor *= x.NEGATED if near(k, "n", 3) else 1.0
        factor *= x.TOLD if k > told_from else 1.0
        score += factor * (x.SEED_WEIGHT if label == "t" else weights[k])
    return score


def test_clauses_match_a_plain_scorer():
    import random

    rng = random.Random(4)
    words = {"i": ["zorg", "idiot"], "t": x.THREATS, "y": x.TARGETS, "n": x.NEGATIONS, "r": x.REPORTS, "q": [*x.OPENERS, ":"], "o": ["tree", "house", "went"]}
    s = x.Scanner({"zorg": 4.0}, {})
    seen = set()
    for _ in range(4000):
        labels = [rng.choice("ityrnqooo") for _ in range(rng.randrange(1, 12))]
        said = [rng.choice(words[z]) for z in labels]
        want = plain_score(labels, [4.0 if w == "zorg" else x.SEED_WEIGHT for w in said])
        assert s.clause(" ".join(said)) == pytest.approx(want), (labels, said)
        seen.add(round(want, 6))
    assert len(seen) > 50


CLAUSES = [
    ("you are an idiot", 1), ("they are scum and you know it", 1), ("I will kill you", 1), ("we destroy them all", 1), ("you should get hurt", 1), ("your friend is a bastard", 1),
    ("ich werde dich töten", 1), ("euch trottel will keiner", 1), ("je vais tuer toi et lui", 1), ("vous frapper sera simple", 1), ("ustedes son unos cretinos", 1), ("voy a matar a ustedes", 1),
    ("you are not an idiot", 0), ("nobody said that you are scum", 0), ("I would never kill you", 0), ("we do not destroy them", 0), ("kill time before lunch", 0), ("the storm may destroy a house", 0),
    ("she said that you are an idiot", 0), ("he wrote : you scum", 0), ("er sagte dass ihr ein trottel", 0), ("elle dit que vous frapper", 0), ("dijo que ustedes son idiotas", 0), ("ich werde dich nicht töten", 0),
]


def test_the_grammar_decides_labelled_clauses():
    """With the machine all clauses are told apart; with one that changes nothing half of the harmless ones are taken for toxic."""

    class Same(x.Transducer):
        def step(self, state, label):
            return state, label, 1.0

    ab = (2.9, -5.4)
    verdicts = {}
    for name, machine in (("grammar", None), ("none", Same())):
        s = x.Scanner({}, {}, machine)
        verdicts[name] = [x.chance(x.np.log1p(s.document(t)[0]), ab) >= x.CUT for t, _ in CLAUSES]
    want = [bool(y) for _, y in CLAUSES]
    assert verdicts["grammar"] == want
    assert sum(a != b for a, b in zip(verdicts["none"], want)) >= 10


def test_the_grammar_decides_after_training(spark):
    """A learned word in clauses that differ only in who says what of whom."""
    filler = lambda i: " ".join(f"{chr(97 + (i * k) % 26)}w{chr(97 + (i // 7 + k) % 26)}" for k in range(9))
    frames = ["you are not {} today", "he said that you are {}"]
    rows = [(i, f"{filler(i)}. {'you are zorgy' if i % 2 else 'what a zorgy thing'}. {filler(i + 1)}", 1) for i in range(240)]
    rows += [(1000 + i, f"{filler(i)}. {frames[i % 2].format('zorgy') if i < 12 else 'you are fine, what a good thing'}. {filler(i + 3)}", 0) for i in range(900)]
    m = x.train(spark.createDataFrame(rows, "doc_id long, text string, y int"))
    s = x.Scanner(m.words, m.beginnings)
    p = lambda t: float(x.chance(x.np.log1p(s.document(t)[0]), m.ab))
    assert set(m.words) == {"zorgy"}
    assert p("you are zorgy today") > p("what is zorgy") > p("he said that you are zorgy") > p("you are not zorgy today") > p("nothing here")
    assert p("what is zorgy") >= 0.5 > p("you are not zorgy today")


def plain_counts(rows):
    """Per entry: ids of toxic documents, their different texts, ids of others."""
    import collections

    import xxhash

    pos, texts, neg = (collections.defaultdict(set) for _ in range(3))
    part = {}
    for doc_id, text, y in rows:
        w = x.LETTERS.findall(text.lower())
        own = min((xxhash.xxh64_intdigest(" ".join(w[i : i + 3])) for i in range(max(1, len(w) - 2))), default=1 << 63) - (1 << 63)
        part[doc_id] = own % x.PARTS
        for e in {("w", z) for z in w} | {("b", z[:k]) for z in w for k in x.BEGINNINGS if len(z) >= k}:
            (pos if y else neg)[e].add(doc_id)
            if y:
                texts[e].add(own)
    return pos, texts, neg, part


def plain_entries(rows):
    import math

    pos, texts, neg, _ = plain_counts(rows)
    n, bad = len(rows), sum(y for *_, y in rows)
    known = [e for e in pos if len(pos[e]) >= x.LEAST_SUPPORT]
    support = max(x.LEAST_SUPPORT, math.ceil((math.log(max(1, len(known))) + 3) / math.log(n / bad)))
    odds = {e: math.log((len(pos[e]) + 0.5) / (bad + 1)) - math.log((len(neg[e]) + 0.5) / (n - bad + 1)) for e in known if len(texts[e]) >= support}
    odds = {e: o for e, o in odds.items() if o >= x.LEAST_ODDS}
    words, begins = {z: o for (k, z), o in odds.items() if k == "w"}, {}
    for z in sorted((z for k, z in odds if k == "b"), key=len):
        inner = [e for e in odds if e[1].startswith(z) and (len(e[1]) > len(z) or e[0] == "w")]
        if all(len(pos[e]) < 0.9 * len(pos["b", z]) for e in inner) and not any(z.startswith(b) for b in begins):
            begins[z] = odds["b", z]
    return words, begins


def test_entries_and_calibration_against_plain_counts(spark):
    """The lexicon of the labelled rows, and the logistic on totals that each part gets from the others' lexicon."""
    d, lab = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    sample = drawn(d, lab, "toxic", x.SAMPLE, ~fold(5))
    rows = [tuple(r) for r in sample.collect()]
    words, begins = plain_entries(rows)
    m = x.train(sample)
    assert m.words == pytest.approx(words) and m.beginnings == pytest.approx(begins) and words
    part, got = plain_counts(rows)[3], []
    for k in range(x.PARTS):
        s = x.Scanner(*plain_entries([r for r in rows if part[r[0]] != k]))
        got += [(s.document(t)[0], y) for i, t, y in rows if part[i] == k]
    total, y = x.np.array([g[0] for g in sorted(got)]), x.np.array([g[1] for g in sorted(got)])
    a, b = x.logistic(x.np.log1p(total), y)
    assert m.ab == pytest.approx((a, b), rel=1e-6)


def test_held_out_of_the_large_table(spark):
    d, lab = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    r = x.predict(d, x.model_for(d, lab), fold(5)).where("held_out").join(lab.where("toxic IS NOT NULL"), "doc_id").collect()
    bad = [z.predicted for z in r if z.toxic == 1]
    assert len(bad) > 90 and sum(bad) >= 0.9 * len(bad) and not any(z.predicted for z in r if z.toxic == 0)
