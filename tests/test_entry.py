"""Every registered query that has SQL gives the same rows as DuckDB."""

import glob
import os

import duckdb
import pytest

import gridverity.plans.capability_queries  # noqa: F401  (registers queries)
import gridverity.plans.source_queries  # noqa: F401
from gridverity.plans.queries import ORACLE, QUERIES


def normal(value):
    if value is None or value != value:
        return None
    if isinstance(value, float):
        return round(value, 6)
    return str(value)[:10] if hasattr(value, "year") else value


def rows(frame):
    cols = sorted(frame.columns)
    return sorted(([normal(v) for v in row] for row in frame[cols].astype(object).itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, sf_dir, duck, name):
    ours, theirs = QUERIES[name](spark, sf_dir).toPandas(), duck.sql(ORACLE[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    got, want = rows(ours), rows(theirs)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g == pytest.approx(w, abs=2e-6) if all(isinstance(x, (int, float)) for x in g if x is not None) and None not in g else repr(g) == repr(w)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_ensembles_of_certain_events_match_sql(spark, sf_dir, tmp_path):
    """All observations reach 20, none of variable A reaches 30: areas under the curve that are undefined, and some that are not."""
    con = duckdb.connect()
    con.execute(f"create table orders as select * from '{sf_dir}/orders.parquet'")
    con.execute(f"create table lineitem as select * replace (20 + l_quantity % (case l_returnflag when 'A' then 5 else 20 end) as l_quantity) from '{sf_dir}/lineitem.parquet'")
    for name in ("orders", "lineitem"):
        con.execute(f"copy {name} to '{tmp_path}/{name}.parquet' (format parquet)")
    got, want = rows(QUERIES["fdp_ens"](spark, str(tmp_path)).toPandas()), rows(con.sql(ORACLE["fdp_ens"]).df())
    assert got == want
    assert 0.0 in {x for r in want for x in r}
