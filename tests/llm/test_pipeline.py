import pytest

import corpus_pipeline as p
from tests.llm.helpers import SF, awkward
from tests.llm.test_simhash import brute, fp
from tidemark.llm import mixing, secrets, simhash, toxicity
from tidemark.llm.common import forget, table, written


def test_stages_one_by_one(spark):
    docs = table(spark, SF, "documents")
    assert [n for n, _ in p.STAGES] == ["toxicity", "simhash_near_dedup", "secret_scans", "mixing", "packing"]
    first = p.without_toxic(spark, docs, SF)
    m = toxicity.model_for(docs, table(spark, SF, "labels"))
    bad = {r.doc_id for r in toxicity.predict(docs, m, toxicity.fold(5)).where("predicted = 1").collect()}
    assert first.columns == docs.columns and {r.doc_id for r in first.collect()} == {r.doc_id for r in docs.collect()} - bad
    second = p.without_near_copies(spark, first, SF)
    want = {d for d, _, c in brute([(r.doc_id, fp(r.text)) for r in first.collect()]) if d == c}
    assert second.columns == docs.columns and {r.doc_id for r in second.collect()} == want
    third = p.without_secrets(spark, second, SF)
    found = {r.doc_id: r.spans for r in secrets.secret_spans(second).collect()}
    before = {r.doc_id: r for r in second.collect()}
    for r in third.collect():
        b = before.pop(r.doc_id)
        assert (r.text == b.text) == (found[r.doc_id] == "") and (r.lang, r.source) == (b.lang, b.source)
        assert r.text is None or r.n_chars == len(r.text)
    assert not before
    fourth = p.mixed(spark, third, SF)
    want = {r.doc_id for r in mixing.mixture(third, p.MIX).collect()}
    assert fourth.columns == docs.columns and sorted(r.doc_id for r in fourth.collect()) == sorted(want)


def test_run(spark):
    rows = p.run(spark, SF).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024 and (at == 1024 or at & (at - 1) == 0)


def test_awkward_tables(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, clashing columns and an empty table go through every stage."""
    d = awkward(spark)
    labels = spark.createDataFrame([(1, 0, 1), (5, 0, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for docs, rows in ((d, 10), (d.limit(0), 0)):
        at = docs
        for i, (_, stage) in enumerate(p.STAGES):
            out = stage(spark, at, str(tmp_path))
            if i < len(p.STAGES) - 1:
                assert out.columns == d.columns
                at = written(out)
                assert (at.count() > 0) == (rows > 0)
            else:
                got = out.collect()
                assert bool(got) == (rows > 0) and {r.doc_id for r in got} == {r.doc_id for r in at.select("doc_id").collect()}


def test_rows_of_one_id_stay_unless_they_are_alike(spark):
    """Ids 3 and 5 share a text; 5 has six more, all different. What stays doesn't depend on how rows lie in partitions."""
    kinds = ["alpha beta gamma delta epsilon", "one two three four five six", "le la les des une dans", "der die das und nicht mit", "zig zag zog zug zeg", "lorem ipsum dolor sit amet"]
    rows = [(3, "a text that both of them have", "s"), (5, "a text that both of them have", "t"), *[(5, k, "t") for k in kinds], (5, kinds[0], "t"), (5, kinds[0], "u"), (None, kinds[1], "n"), (None, "no id, alone here", "n"), (None, "no id, alone here", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = [sorted(map(tuple, simhash.one_of_each(df.repartition(n)).collect()), key=str) for n in (1, 3, 7)]
    assert kept[0] == kept[1] == kept[2]
    assert {fp(t) for _, t, _ in kept[0]} == {fp(t) for _, t, _ in rows} and len(kept[0]) == len({fp(t) for _, t, _ in rows}) == 8
    assert {(d, t) for d, t, _ in kept[0]} == {(3, rows[0][1]), *[(5, k) for k in kinds], (None, "no id, alone here")}


def test_forget_removes_what_was_written(spark):
    w = written(spark.range(3))
    assert w.count() == 3
    forget(spark)
    with pytest.raises(Exception):
        w.count()
    assert written(spark.range(3)).count() == 3
