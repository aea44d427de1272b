"""Queries on questions against their SQL, on texts and keys that the given tables hardly have."""

import duckdb
import pytest

from strandweave.plans import registry

TEXTS = ["inégal", "éin", "in", "put ß", "pick in_", "take iń", "İn", "", "a b c d e f is?  g", "what put in", "into x"]


@pytest.mark.parametrize("name", ["score_candidate", "template_reasons", "rule_routing", "format_reasons"])
def test_query_equals_sql(spark, tmp_path, name):
    rows = [(c, t, f"{x} and more" if t % 2 else x) for x, c in zip(TEXTS, range(100, 200)) for t in range(14)]
    rows += [(7, None, "in x put"), (None, 3, "a b in"), (5, 4, None), (-1, 0, "x in"), (-15, 0, "put in x"), (-8, 7, "put in")]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = registry.queries()[name](spark, str(tmp_path))
    columns = sorted(got.columns)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    found = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in found.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == want
