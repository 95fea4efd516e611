"""Registered queries against their SQL on the smallest tables.

The quick ones run here; ``oracle_check.py`` runs them all.
"""

from pathlib import Path

import oracle_check
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUICK = ("url_parse", "page_ids", "scrub_tokens", "display_text", "asof_click_to_purchase", "dedupe_states", "edges_without_pause", "retain_latest", "page_outline", "enum_columns", "merged_controls", "gap_bursts", "bursts", "volume_breaker", "overlay_memory", "structured_endpoints", "pause_gate", "built_files", "built_trails", "built_pagers")


@pytest.fixture(scope="module")
def con():
    if not Path(SF).exists():
        pytest.skip("the given tables are not here")
    return oracle_check.connection(SF)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, con, name):
    assert oracle_check.compare(spark, con, SF, name, entry.queries()[name], entry.oracle_sql()[name]) is None

