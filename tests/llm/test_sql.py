"""The queries that SQL can express, on the small tables with odd texts added: the same rows."""

import duckdb
import pytest

from stratacube.llm import queries

ODD = [(9001, None), (9002, ""), (9003, " \t\n"), (9004, "One"), (9005, "one"), (9006, "one two"), (9007, "ONE  TWO"), (9008, "a b c"), (9009, "a b c a b c"), (9010, "é É a|b 'x'"), (9011, "rare words only here"), (9021, "rare words only here too")]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, data, tmp_path, name):
    odd = spark.createDataFrame(ODD, "doc_id long, text string")
    spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").union(odd).coalesce(1).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.read.parquet(f"{data}/benchmark.parquet").coalesce(1).write.parquet(f"file://{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW benchmark AS SELECT * FROM '{data}/benchmark.parquet'")
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{next((tmp_path / 'documents.parquet').glob('*.parquet'))}'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, f"file://{tmp_path}")
    assert sorted(got.columns) == sorted(want.columns)
    have, need = sorted(map(tuple, got.select(*want.columns).collect())), sorted(want.fetchall())
    assert len(have) == len(need)
    for a, b in zip(have, need, strict=True):
        assert all(abs(x - y) < 2e-6 if isinstance(x, float) else x == y for x, y in zip(a, b, strict=True)), (a, b)
