"""Plan-shape checks: the scale properties found with explain() stay true."""

import contextlib
import io

from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_SMALL
from ruleweave.operators.auc import grouped_auc
from ruleweave.operators.stats import profile
from ruleweave.sources import testdata as td


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def test_flagship_scans_each_table_once(spark):
    p = plan(E.queries()["rule_risk"](spark, SF_SMALL))
    assert p.count("lineitem.parquet") == 1
    assert p.count("orders.parquet") == 1


def test_subpopulation_table_has_no_join_of_hits_and_predictions(spark):
    p = plan(E.queries()["rule_subpopulation_models"](spark, SF_SMALL))
    # only the joins of the case build remain (lineitem agg, customer, nation, region)
    assert p.count("Join ") <= 4
    assert p.count("lineitem.parquet") == 1


def test_profile_has_no_expand(spark):
    p = plan(profile(td.cases(spark, SF_SMALL), exact=False))
    assert "Expand" not in p
    assert p.count("lineitem.parquet") == 1
    assert "Expand" not in plan(profile(td.cases(spark, SF_SMALL)))


def test_grouped_auc_has_no_single_partition_window(spark):
    df = spark.range(1000).select((F.col("id") % 97 / 97.0).alias("prob"),
                                  (F.col("id") % 3).cast("int").alias("y"),
                                  (F.col("id") % 2).alias("g"))
    p = plan(grouped_auc(df, ["g"]))
    assert "SinglePartition" not in p


def test_projection_pruned_and_filter_pushed(spark):
    q = E.queries()["stratified_split"](spark, SF_SMALL)
    p = plan(q)
    assert "LessThan(start_date" in p
