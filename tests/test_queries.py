"""Every query with a SQL twin has a place in the catalog; a sample is compared on the smallest tables."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools_check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
SAMPLE = ["I4_repeat_punctuation_latin", "D1_qa_report", "D20_admin_token_daily", "K7_plan_audit", "E23_redeem_codes", "A8_segment_html_qa", "C16_chunk_diff"]


def test_catalog_is_consistent():
    assert set(oracle_sql()) <= set(queries()) and len(queries()) > 150


def test_entry(spark):
    assert "total" in entry(spark).columns


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries()[name](spark, SF)
    cur = con.execute(oracle_sql()[name])
    assert rows_of(df.columns, df.collect()) == rows_of([c[0] for c in cur.description], cur.fetchall())


def test_queries_are_listed_without_a_session():
    import subprocess
    import sys

    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], capture_output=True, text=True, timeout=120)
    assert said.returncode == 0 and int(said.stdout.split()[-2]) > 150, said.stderr[-500:]
