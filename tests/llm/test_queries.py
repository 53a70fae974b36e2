import duckdb
import pytest

from quernel.llm.queries import QUERIES, SQL

COLUMNS = {
    "p1_found": [("article_id", "bigint"), ("section_no", "int")], "p3_found": [("fetch_id", "bigint")], "p4_found": [("entry_id_a", "bigint"), ("entry_id_b", "bigint")],
    "p5_found": [("conv_id", "string")], "p8_found": [("doc_id", "bigint"), ("end_char", "int")],
}


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, small, name):
    df = QUERIES[name](spark, small)
    rows = df.collect()
    assert name not in COLUMNS or df.dtypes == COLUMNS[name]
    assert len({c.lower() for c in df.columns}) == len(df.columns)
    if name in SQL:
        con = duckdb.connect()
        for t in ("articles", "sessions", "messages", "rollout_lines", "queue_entries", "documents", "mix_targets"):
            con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
        want = con.sql(f"select {', '.join(df.columns)} from ({SQL[name]})").fetchall()
        assert sorted(map(tuple, rows)) == sorted(want)
