import duckdb
import pytest

from tests.llm.helpers import SF, awkward
from tidemark.llm import mixing as m
from tidemark.llm.common import table


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("mix", [m.Mix(), m.Mix(share=(9, 5), max_epochs=3), m.Mix(share=(1, 2), max_epochs=1, seed="other")])
def test_matches_sql(spark, mix):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = m.mixture(table(spark, SF, "documents"), mix)
    want = c.execute(m.oracle(mix)).fetchall()
    assert rows(got) == sorted(want, key=str)
    assert got.columns == ["doc_id", "domain", "lang", "source", "tokens", "times", "leaf_budget"]


def test_shortages_go_to_siblings_first(spark):
    leaves = spark.createDataFrame([("domain0", "en", "a", 10), ("domain0", "en", "b", 1000), ("domain0", "de", "c", 1000), ("domain1", "en", "d", 2000)], "domain string, lang string, source string, tokens long")
    got = {r.source: r.budget for r in m.leaf_budgets(leaves, m.Mix(share=(800, 4010), max_epochs=1, weights={})).collect()}
    assert got == {"a": 10, "b": 190, "c": 200, "d": 400}
    # domain0 as a whole falls short: only then does domain1 get more
    leaves = leaves.where("source <> 'b'").where("source <> 'c'")
    got = {r.source: r.budget for r in m.leaf_budgets(leaves, m.Mix(share=(800, 2010), max_epochs=1, weights={})).collect()}
    assert got == {"a": 10, "d": 790}


def test_awkward_rows(spark):
    d = awkward(spark)
    got = m.mixture(d, m.Mix(share=(2, 1))).collect()
    assert len([r for r in got if r.tokens]) == len([r for r in d.collect() if r.text]) and {r.times for r in got if r.tokens} == {2}
    assert m.mixed(d, m.Mix(max_epochs=1)).columns == d.columns
    assert m.mixture(d.limit(0)).count() == 0
