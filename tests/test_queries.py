"""Each query against its SQL on the smallest tables."""

import os

import pytest

from lodestone.plans import registry

SF = "/root/testdata/sf0.001"


def values(rows, columns):
    plain = lambda v: None if v is None or v != v else round(v.item() if hasattr(v, "item") else v, 6) + 0.0 if isinstance(v.item() if hasattr(v, "item") else v, float) else v.item() if hasattr(v, "item") else v
    return sorted(repr(tuple(plain(v) for v in r)) for r in rows[columns].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    want = duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert values(got, sorted(got.columns)) == values(want, sorted(got.columns))


@pytest.mark.parametrize("name", ["stance_parse", "stance_scores"])
def test_stances_of_odd_responses(spark, tmp_path, name):
    """Phrases beside letters that aren't ASCII or in other cases, objects, a vertical tab, special lower case, no text."""
    duckdb = pytest.importorskip("duckdb")
    said = ["\u00f1yes", "yes\u00f3", "yes_", "ye\u017f", "un\u212anown", "\u0130s it", "false\u00e9 yes", '{"status": "refused"}', '{"verdict": "true", "x": "unknown"}', "a\x0bb a", "\u039f\u03a3 Is", "1,000 YES", "", None]
    asked = ["Is a\x0bb", "yes", "", None, "unknown 1000", "\u039f\u03a3 a", "b a"]
    rows = [(k, turn, "assistant" if turn % 2 else "user", (said if turn % 2 else asked)[(k // 2 + turn) % (14 if turn % 2 else 7)]) for k in range(100) for turn in (2 * (k % 2), 2 * (k % 2) + 1)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got, want = (x.astype(object).where(x.notna(), None) for x in (registry.queries()[name](spark, str(tmp_path)).toPandas(), con.execute(registry.oracle_sql()[name]).df()))
    assert len(got) and values(got, sorted(got.columns)) == values(want, sorted(got.columns))


@pytest.mark.parametrize("name", sorted(registry.queries().keys() - registry.oracle_sql().keys()))
def test_rows(spark, name):
    got = registry.queries()[name](spark, SF).toPandas()
    assert len(got) and not got.isna().all().any()
