"""The driver's entry file: names agree, and queries match their SQL in DuckDB on the smallest tables."""

import os

import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ["relations_callers", "caller_counts", "edge_dedupe_first", "two_hop_inference", "pagerank_10it", "delta_replay", "bm25_topk", "calibration_report", "event_session", "predicate_callers", "delta_replay_graph", "bm25f", "region_overlap", "graph_union"]


def norm(df, columns):
    one = lambda v: None if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v).replace(".000000", "")
    return sorted(str(tuple(map(one, row))) for row in df[columns].itertuples(index=False, name=None))


def test_oracles_have_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", SOME)
def test_against_duckdb(spark, name):
    import duckdb

    import __spark_entry__ as e

    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    mine, oracle = e.queries()[name](spark, SF).toPandas(), con.sql(e.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(oracle.columns)
    assert norm(mine, sorted(mine.columns)) == norm(oracle, sorted(mine.columns))
