"""Every query with SQL gives the rows that DuckDB gives; the entry module works with and without its optional part."""

import datetime
import decimal
import math
import os
import subprocess
import sys

import duckdb
import pytest

from tidemark.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tiny}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.9g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_as_duckdb(spark, duck, tiny, name):
    df = registry.QUERIES[name](spark, tiny)
    cursor = duck.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in cursor.fetchall())
    assert sorted(tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()) == want
    assert want or name in ("watchlist_page", "dup_rejection", "target_errors")


#: Queries that differed from their SQL where a price is 0, by which SQL divides to infinity or NaN.
ZEROS = [
    "features_atr",
    "features_range_gap",
    "features_at_quotes",
    "features_at_quotes_in_blocks",
    "live_movement",
    "model_majority",
    "ablation_deltas",
    "model_ridge_1d",
    "model_comparison",
    "model_comparison_by_fold",
    "model_comparison_by_other_names",
    "model_logistic_fit",
    "model_logistic_documents",
    "expanding_train_states",
]


@pytest.fixture(scope="module")
def zeros(tiny, tmp_path_factory):
    """Events of which some have a value of 0, purchases and each user's first one among them."""
    path = tmp_path_factory.mktemp("zeros")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"COPY (SELECT * REPLACE (CASE WHEN event_id % 37 = 5 OR user_id % 5 = 1 AND ts = min(ts) OVER (PARTITION BY user_id) THEN 0 ELSE value END AS value) FROM read_parquet('{tiny}/events.parquet')) TO '{path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{path}/events.parquet')")
    return str(path), con


def flat(v):
    return [flat(x) for x in v] if isinstance(v, (list, tuple)) else plain(v)


@pytest.mark.parametrize("name", ZEROS)
def test_as_duckdb_with_prices_of_zero(spark, zeros, name):
    path, con = zeros
    df = registry.QUERIES[name](spark, path)
    cursor = con.execute(registry.ORACLE_SQL[name])
    at = {c[0]: i for i, c in enumerate(cursor.description)}
    want = sorted((flat([r[at[c]] for c in sorted(at)]) for r in cursor.fetchall()), key=str)
    assert sorted((flat([r[c] for c in sorted(at)]) for r in df.collect()), key=str) == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_without_sql_runs(spark, tiny, name):
    assert registry.QUERIES[name](spark, tiny).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 11  # folds up to the last hour of the month
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_optional_part():
    code = "import sys; sys.modules['tidemark.llm'] = None; import __spark_entry__ as e; print(len(e.queries()))"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True)
    assert out.stdout.strip() == str(len(registry.QUERIES)), out.stderr


def test_plans_prune_push_and_stay_in_the_jvm(spark, tiny):
    plan = registry.QUERIES["features_at_quotes"](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "event_type,purchase" in plan
    plan = registry.QUERIES["panel_peer_relative"](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "l_tax" not in plan and "o_totalprice" not in plan
