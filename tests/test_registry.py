"""The driver contract: names, schemas and a few results against DuckDB."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

import __spark_entry__ as entry  # noqa: E402
from check import TABLES, canonical  # noqa: E402

from orderweave.plans import registry  # noqa: E402

SAMPLE = ("order_overview", "resolve_lines_without_fuzzy", "generate_messages", "parse_order_tables",
          "usage_trailing", "edi_validate", "categorise_findings")


def test_every_query_has_an_oracle():
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries)
    assert set(registry.QUERIES) <= set(queries)
    assert set(registry.QUERIES) <= set(oracle)


@pytest.mark.parametrize("name", SAMPLE)
def test_results_match(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = entry.queries()[name](spark, sf).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    assert canonical(got) == canonical(want)


def test_flagship(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["id", "customer", "line_count", "flagged_count", "unmatched_count",
                            "can_generate"]
    assert rows.count() > 0
