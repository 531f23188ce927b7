"""Sources made of a table's rows are read by more than one task, though the table is one row group."""

import pytest
from pyspark.sql import functions as F

from codeloom.plans import code_queries, language_queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("made", [language_queries._ts, language_queries._go, language_queries._py, code_queries.sources])
def test_sources_lie_in_several_partitions(spark, made):
    assert made(spark, SF).select(F.spark_partition_id().alias("p")).distinct().count() > 1
