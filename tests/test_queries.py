"""Every query of the library against its SQL, and the entry module's contract."""

import pytest

from tests.oracle import same
from tidemark import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_sql(spark, data, name):
    same(catalogue.QUERIES[name](spark, data), catalogue.SQL[name], data)


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["op_summarise", "agg_merge_ops", "agg_evidence_dedupe", "lim_locations"])
def test_partitioning_does_not_show(spark, data, name):
    def run(n):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        return sorted(map(str, catalogue.QUERIES[name](spark, data).collect()))

    try:
        assert run(3) == run(17)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
