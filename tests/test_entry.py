"""The registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

from quillmeter import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = "t2_profile_counts t4_estimate_by_lang t7_trim_both h5_lane_plan a5_markdown_sections c1_window_chunks r4_bm25_topk r9_hybrid_search p3_pack p10_pack_files l6_claims_wide_window g1_complexity_scores g7_budget_gate g8_recompression g14_reservations f3_rightsizing f7_ledger_totals f16_changes_between v4_contract_violations st_session_windows st_offer_claims".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    names = sorted(got.columns)
    want = duck.execute(catalog.oracle_sql()[name])
    have = [d[0] for d in want.description]
    assert sorted(have) == names
    rows = sorted(repr(tuple(r[have.index(n)] for n in names)) for r in want.fetchall())
    assert sorted(repr(tuple(r[n] for n in names)) for r in got.collect()) == rows


def test_every_sql_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
