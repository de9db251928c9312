"""Queries with a DuckDB twin."""

import duckdb
import pytest
from compare import compare, duck

from __spark_entry__ import oracle_sql
from pixelweave.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, name):
    assert oracle_sql()[name] == ORACLES[name]
    _, why = compare(spark, duck(SF), name, QUERIES[name], ORACLES[name], SF)
    assert why is None


def test_chat_rows_of_one_turn(spark, tmp_path):
    """Tied, repeated and null turns: every row is a message."""
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, None, "assistant", "same"), (1, None, "assistant", "same"),
            (2, 3, "assistant", "x"), (2, 3, "assistant", "longer"), (2, 3, "user", "y"), (3, None, None, None), (None, 0, "user", "q"), (None, 0, "user", "q")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = {r[0]: r[1:] for r in con.execute(ORACLES["op3_chat_format"]).fetchall()}
    got = {r[0]: tuple(r[1:]) for r in QUERIES["op3_chat_format"](spark, str(tmp_path)).collect()}
    told = got.pop(2), want.pop(2)  # the order of different rows of one turn is open in SQL
    assert got.keys() == want.keys() and all(got[i] == want[i] for i in got) and got[1][0] == 6
    assert told[0][0] == told[1][0] == 3 and told[0][2] == told[1][2] == len("xlonger") and told[0][4] == told[1][4]
