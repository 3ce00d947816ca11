"""Every registered query of the engine against its SQL."""

import pytest
from oracle import compare

from evidentia.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert compare(spark, SF, catalogue.queries()[name], catalogue.oracle_sql()[name]) == ""


def test_folded_dedup_keeps_the_most_confident(spark):
    assert catalogue.queries()["ocr_dedup_folded"](spark, SF).count() > 0


def test_partitions_do_not_change_results(spark):
    from oracle import rows_of_spark

    one = rows_of_spark(catalogue.queries()["verdict_by_case"](spark, SF))
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert rows_of_spark(catalogue.queries()["verdict_by_case"](spark, SF)) == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
