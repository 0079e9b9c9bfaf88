"""Queries whose doubles differ in their last bits from one evaluation to the next, as sums over a shuffle do."""

import random

import pytest
from pyspark.sql import functions as F

from featherlens import plans
from featherlens.operators import stats
from featherlens.plans import fixtures as fx

from .oracle import compare, connect

SF = "/root/testdata/sf0.001"


def shaken(x):
    """x with another rounding error at each evaluation."""
    noise = F.udf(lambda v: None if v is None else v * (1 + random.uniform(-1e-13, 1e-13)), "double").asNondeterministic()
    return noise(x)


@pytest.mark.parametrize("name", ["agg_vad_summary", "agg_vad_bundle", "agg_vad_fold_metrics", "stat_alpha_prime", "stat_spearman", "pred_finite_mask"])
def test_ranks_of_doubles_that_change(spark, monkeypatch, name):
    emb = fx.emb
    monkeypatch.setattr(fx, "emb", lambda spark, sf: emb(spark, sf).withColumn("x", shaken(F.col("x"))))
    assert compare(spark, connect(SF), plans.QUERIES[name], plans.SQL[name], SF) == ""


def test_rank_correlation_keeps_all_pairs(spark):
    df = spark.range(200).select(F.lit("a").alias("view"), shaken(F.col("id") + 1.0).alias("a"), shaken(F.col("id") * -2.0 - 1).alias("b"))
    r = stats.spearman(df, ["view"], "a", "b").first()
    assert r.n == 200 and r.rho == pytest.approx(-1)
