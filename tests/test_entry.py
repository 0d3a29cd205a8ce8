"""The driver's contract: every query has a callable, oracles only name queries, and results match them."""

import glob
import os

import pytest

DATA = os.environ.get("SEQMESH_TABLES", "/root/testdata/sf0.001")


def test_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
def test_core_queries_match_their_oracles(spark):
    import duckdb

    from seqmesh.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    for name in ("hamming_histogram", "threshold_edges", "initial_distances", "parallel_edge_last_wins", "nation_graph_apsp", "apsp_unreachable", "pam_best_swap", "fasta_roundtrip", "dot_one_line", "pam_assign_named", "pam_random_start"):
        got = QUERIES[name](spark, DATA)
        want = con.sql(ORACLES[name])
        cols = sorted(got.columns)
        assert cols == sorted(want.columns)
        order = [want.columns.index(c) for c in cols]
        a = sorted((tuple(r[c] for c in cols) for r in got.collect()), key=repr)
        assert a == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=repr), name


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
def test_paths_of_equal_vectors_match_their_oracles(spark, tmp_path):
    """Equal sign strings are adjacent at distance 0."""
    import duckdb

    from seqmesh.queries import ORACLES, QUERIES

    con = duckdb.connect()
    con.sql(f"CREATE TABLE v AS SELECT * FROM '{DATA}/embeddings.parquet' WHERE vec_id < 50")
    con.sql("CREATE TABLE embeddings AS SELECT * FROM v UNION ALL SELECT * REPLACE ((vec_id + 50)::BIGINT AS vec_id) FROM v")
    con.sql(f"COPY embeddings TO '{tmp_path}/embeddings.parquet'")
    for name in ("pam_assign", "pam_best_swap", "pam_strip_swap_costs", "apsp_reachable", "apsp_delta_stepping", "apsp_tiles"):
        want = con.sql(ORACLES[name])
        got = QUERIES[name](spark, str(tmp_path)).select(*want.columns).collect()
        assert sorted(map(tuple, got)) == sorted(want.fetchall()), name


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
def test_edges_that_are_read_once_are_not_written(spark, monkeypatch):
    from seqmesh import queries

    def written(*_):
        raise AssertionError("edges were written")

    monkeypatch.setattr(queries, "materialise", written)
    assert queries.symmetric_edges(spark, DATA).count() == 2 * queries.threshold_edges(spark, DATA).count()
    assert queries.dot_lines(spark, DATA).where("kind = 2").count() == queries.threshold_edges(spark, DATA).count()
