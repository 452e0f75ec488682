import re

from tests.llm.helpers import DOCS, SF, awkward
from tidemark.llm import quality_rules as q
from tidemark.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    seen, twice = {}, set()
    for i in range(len(w) - 7):
        k = tuple(w[i : i + 8])
        if k in seen:
            twice |= {seen[k], i}
        seen.setdefault(k, i)
    covered = {j for i in twice for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n_sym = sum(c in "#*$%&|<>" for c in text)
    return len(w), sum(map(len, w)), n_sym, len(lines) - len(set(lines)), len(covered)


def check(docs):
    got = {(r.doc_id, *r[1:6], r.base_failed) for r in q.quality_rules(docs).collect()}
    want = set()
    for r in docs.collect():
        b = brute(r.text)
        want.add((r.doc_id, *b, b[0] < 20 or 100 * b[4] > 30 * b[0]))
    assert got == want


def test_matches_brute_force(spark):
    check(table(spark, SF, "documents"))


def test_awkward_rows(spark):
    check(awkward(spark))
    assert q.quality_rules(awkward(spark)).count() == 10


def test_empty_table(spark):
    assert q.quality_rules(awkward(spark).limit(0)).count() == 0


def test_clean_kept_and_junk_dropped(spark):
    d = table(spark, "/root/testdata/sf0.01", "documents")
    lab = table(spark, "/root/testdata/sf0.01", "labels").where("quality is not null")
    r = q.quality_rules(d).join(lab, "doc_id").select("kept", "base_failed", "quality").collect()
    good = [x.kept for x in r if x.quality == 1 and not x.base_failed]
    bad = [x.kept for x in r if x.quality == 0]
    assert sum(good) >= 0.97 * len(good)
    assert sum(bad) <= 0.1 * len(bad)


def test_sketches_merge(spark):
    rated = q.rates(q.measures(table(spark, SF, "documents")))
    a, b = q.sketch(rated.where("doc_id % 2 = 0")), q.sketch(rated.where("doc_id % 2 = 1"))
    merged = a.union(b).groupBy("lang", "source", "rate", "bucket").sum("n")
    assert {tuple(r) for r in merged.collect()} == {tuple(r) for r in q.sketch(rated).collect()}


def verdicts(rows):
    """kept of (lang, source, counts by name, base_failed), by plain loops over sorted bucket values."""
    import math
    from collections import defaultdict

    value = lambda v: 0 if v <= q.FLOOR else max(0, math.ceil(math.log(v / q.FLOOR) / math.log(q.GAMMA)) + 1)
    rate = lambda c, name: c[q.RATES[name][0]] / c[q.RATES[name][1]] if c[q.RATES[name][1]] else 0.0
    pools = defaultdict(list)
    for lang, source, c, _ in rows:
        if c["n_words"] >= 20:
            for name in q.RATES:
                for key in (("own", lang, source), ("lang", lang), ("all",)):
                    pools[key, name].append(value(rate(c, name)))

    def quartile(key, name, p):
        x = sorted(pools[key, name])
        b = next(v for i, v in enumerate(x) if sum(y <= v for y in x) >= len(x) * p)
        return 0.0 if b == 0 else math.sqrt(q.FLOOR * q.GAMMA ** (b - 1))

    out = []
    for lang, source, c, failed in rows:
        kept = not failed
        for name, (_, of, unit) in q.RATES.items():
            n0, n1 = len(pools[("own", lang, source), name]), len(pools[("lang", lang), name])
            if not n0 or not c[of]:
                continue
            at = []
            for p in (0.25, 0.75):
                up = (n1 * quartile(("lang", lang), name, p) + q.PRIOR * quartile(("all",), name, p)) / (n1 + q.PRIOR)
                at.append((n0 * quartile(("own", lang, source), name, p) + q.PRIOR * up) / (n0 + q.PRIOR))
            lo, hi = at
            kept &= not rate(c, name) > (hi + q.SPREAD * max(hi - lo, 1.35 * math.sqrt(unit / (4 * c[of])))) ** 2
        out.append(kept)
    return out


def test_kept_matches_brute_force(spark):
    for docs in (table(spark, SF, "documents"), awkward(spark)):
        rated = q.rates(q.measures(docs)).collect()
        kept = {(r.doc_id, r.lang, r.source, r.n_words, r.word_chars): r.kept for r in q.quality_rules(docs).collect()}
        rows = [(r.lang, r.source, r.asDict(), r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) for r in rated]
        for r, want in zip(rated, verdicts(rows), strict=True):
            assert kept[r.doc_id, r.lang, r.source, r.n_words, r.word_chars] == want, r
    assert len(set(kept.values())) == 2


def test_groups_of_every_size_have_thresholds_of_their_own(spark):
    """A source whose texts are all tables keeps them; one such text among prose goes; so it is for 3 texts and for 300."""
    import random

    word = lambda i, n: [f"word{random.Random(i).randrange(9)}{x}" for x in random.Random(i).sample(range(5000), n)]
    prose = lambda i: " ".join(word(i, 120))
    tables = lambda i: " ".join(f"| {w} |" for w in word(9000 + i, 60))
    rows = [(i, prose(i), "en", "prose") for i in range(300)] + [(1000 + i, tables(i), "en", "tables") for i in range(300)] + [(2000, tables(3), "en", "prose")] + [(3000 + i, prose(i), "de", "few") for i in range(3)] + [(4000, tables(1), "de", "few")]
    r = {x.doc_id: x.kept for x in q.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(r[i] for i in range(300)) and all(r[1000 + i] for i in range(300)) and not r[2000]
    assert all(r[3000 + i] for i in range(3))
