import duckdb
import pytest

import __spark_entry__ as entry
from curatrix.plans import load_all, registry
from tools.check import TABLES, connect, table_rows

load_all()
OWN = sorted(registry.QUERIES)
CHEAP = ["count_by_source", "url_compare_key", "time_window_duplicates", "quarter_hour_groups_exact", "upsert_overwrite", "step_telemetry", "connected_components"]


def test_contract():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 180
    assert duckdb.__version__ and len(TABLES) == 14


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"source", "counted"}


@pytest.mark.parametrize("name", CHEAP)
def test_matches_oracle(spark, sf, name):
    df = entry.queries()[name](spark, sf)
    cur = connect(sf).execute(entry.oracle_sql()[name])
    assert table_rows(df.columns, [tuple(r) for r in df.collect()]) == table_rows([d[0] for d in cur.description], cur.fetchall())


@pytest.mark.parametrize("name", OWN)
def test_every_query_runs(spark, sf, name):
    """All queries outside the text operators, which have their own tests, on the smallest tables.

    Each is planned, with what it runs on the way; those that write, stream or call Python also run to their end.
    """
    df = entry.queries()[name](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    if any(t in name for t in ("write", "stream", "bucket", "clean")) or any(t in plan for t in ("Python", "Pandas", "Arrow")):
        df.write.format("noop").mode("overwrite").save()
