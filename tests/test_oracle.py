"""Whole results of a cross-section of queries beside DuckDB at the smallest scale."""

import pytest

from tools import check_queries as cq

SF = "/root/testdata/sf0.001"
NAMES = """t13_chunks t15_decode_features t20_clauses r14_majority r16_division r20_collapse_runs r22_tile_ranges r30_first_wins
a09_facets a16_contrast a21_index_quantiles a30_name_spans c01_cooccurrence c01_cooccurrence_words c06_gram_candidates c08_longest_run c16_unit_twins
c20_link_quotations v03_knn v03_knn_cells v22_hybrid_thread g11_components g17_layered_parents q01_texttiling_depth q07_spans e03_grid_search s04_lines_by_position x01_request_rate""".split()


@pytest.fixture(scope="module")
def con():
    return cq.connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, con, name):
    state, note, _ = cq.compare(spark, con, name, SF)
    assert state in ("OK", "EMPTY"), note


def test_registry_is_whole():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 230
