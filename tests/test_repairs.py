"""Edge cases of rules, profiles, densities and complete result grids."""

import math

import pytest
from pyspark.sql import functions as F

from ruleweave.functions.bins import attach_stats, equal_width_bins
from ruleweave.functions.rules import Condition, Rule, rule
from ruleweave.operators.density import histogram_density, kde_grid
from ruleweave.operators.match import match_rules
from ruleweave.operators.stats import class_weights, profile
from ruleweave.plans.disagreement import rule_facts
from ruleweave.plans.subpopulation import rule_model_table
from ruleweave.session import ensure_checkpoint_dir


def test_nan_and_empty_sets_in_rules(spark):
    df = spark.createDataFrame([(1, float("nan"), "a"), (2, 3.0, "b"), (3, None, None), (4, -1.0, "a")], "case_id long, x double, c string")
    rules = [rule("gt", ("x", ">", 0.0)), rule("ge", ("x", ">=", 0)), rule("eq", ("x", "==", float(3))), rule("ne", ("x", "!=", 3.0)),
             rule("lt", ("x", "<", 0.0)), rule("none", ("c", "in", [])), rule("all", ("c", "not in", []))]
    got = {}
    for r in match_rules(df, rules).collect():
        got.setdefault(r.rule_id, set()).add(r.case_id)
    assert got == {"gt": {2}, "ge": {2}, "eq": {2}, "ne": {4}, "lt": {4}, "all": {1, 2, 4}}
    import duckdb
    t = duckdb.sql("select * from (values (1, 'nan'::double, 'a'), (2, 3.0, 'b'), (3, null, null), (4, -1.0, 'a')) v(case_id, x, c)")  # noqa: F841
    for r in rules:
        assert {x[0] for x in duckdb.sql(f"select case_id from t where {r.to_sql()}").fetchall()} == got.get(r.rule_id, set())


def test_profile_keeps_large_integers_apart(spark):
    big = 2**53
    df = spark.createDataFrame([(big, "x", 0.0), (big + 1, "x", -0.0), (big + 2, None, 1.5)], "k long, s string, d double")
    p = {r["column"]: r for r in profile(df).collect()}
    assert (p["k"].n_distinct, p["k"].min_text, p["k"].max_text) == (3, str(big), str(big + 2))
    assert (p["s"].n_distinct, p["s"].n_null, p["s"].constant) == (1, 1, True)
    assert (p["d"].n_distinct, p["d"].min_num, p["d"].max_num) == (2, 0.0, 1.5)
    for exact in (True, False, ["k"]):
        empty = profile(df.limit(0), exact=exact).collect()
        assert len(empty) == 3 and all(r.n_rows == 0 and r.n_distinct == 0 for r in empty)
    assert {r["column"]: r.n_distinct for r in profile(df, exact=["k"]).collect()}["k"] == 3


@pytest.mark.parametrize("cells", [None, 32])
def test_density_integrates_to_one_at_any_size(spark, cells):
    n = 2_000_000 if cells else 20_000
    df = spark.range(n).select(F.round(F.randn(5) * 0.05 + 0.5, 5).alias("x"))
    got = sorted(kde_grid(df, [], "x", 0.0, 1.0, 200, cells_per_bandwidth=cells).collect(), key=lambda r: r.grid_index)
    step = got[1].x - got[0].x
    assert abs(sum(r.density for r in got) * step - 1) < 0.01
    assert abs(max(r.density for r in got) - 1 / (0.05 * math.sqrt(2 * math.pi))) < 0.25


def test_density_range_comes_from_the_data(spark):
    df = spark.range(3000).select((F.col("id") / 1000).alias("x"))
    got = sorted(kde_grid(df, [], "x", n_grid=128).collect(), key=lambda r: r.grid_index)
    assert got[0].x < 0 and got[-1].x > 3
    assert abs(sum(r.density for r in got) * (got[1].x - got[0].x) - 1) < 0.01
    inside = sorted(kde_grid(df, [], "x", 0.0, 1.0, 16).collect(), key=lambda r: r.grid_index)
    assert all(abs(r.density - 1 / 3) < 0.02 for r in inside[4:])  # nothing piles up at the end
    bins = histogram_density(df, [], "x", k=10).collect()
    assert sum(r["count"] for r in bins) == 3000


def test_rules_without_a_match_keep_their_rows(spark):
    df = spark.createDataFrame([(i, i % 2, "d", m, i / 10, float(i)) for i in range(10) for m in ("a", "b")],
                               "case_id long, y int, dataset string, model string, prob double, x double")
    rules = [rule("some", ("x", ">", 4.0)), rule("never", ("x", ">", 99.0))]
    got = {(r.rule_id, r.model): r for r in rule_model_table(df, rules).collect()}
    assert set(got) == {(r, m) for r in ("some", "never") for m in "ab"}
    assert (got["never", "a"].n, got["never", "a"].actual, got["never", "a"].auc) == (0, None, None)
    assert got["some", "b"].n == 5
    facts = {r.rule_id: (r.n_train, r.empirical_risk) for r in rule_facts(df, rules).collect()}
    assert facts["never"] == (0, None) and facts["some"][0] == 10


def test_group_statistics_move_no_rows(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(1000).select(F.when(F.col("id") < 900, "hot").otherwise(F.lit(None)).alias("g"), F.col("id").cast("double").alias("x"))
        for out in (equal_width_bins(df, "x", 5, ["g"]), class_weights(df, "g"), attach_stats(df, df.groupBy("g").agg(F.max("x").alias("m")), ["g"])):
            plan = out._jdf.queryExecution().executedPlan().toString().split("Subquery")[0]
            assert "Join" not in plan and "Exchange" not in plan
        assert attach_stats(df, df.groupBy("g").agg(F.max("x").alias("m")), ["g"]).where("m is null").count() == 0
        assert equal_width_bins(df, "x", 5, ["g"]).groupBy("g", "bin").count().where("bin is null").count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_condition_rejects_unknown_operators():
    with pytest.raises(ValueError):
        Condition("x", "~", 1)
    assert Rule("r").to_spark_sql() == "true"


def test_checkpoint_folder_is_needed_on_a_cluster():
    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        ensure_checkpoint_dir(Session())


def test_quantile_buckets_do_not_follow_an_outlier(spark):
    from ruleweave.operators.quantiles import bucketed, exact_quantiles, value_counts_table
    df = spark.range(20_000).select(F.when(F.col("id") == 0, 1e12).otherwise(F.col("id") / 20_000).alias("x"))
    counts = value_counts_table(df, "x")
    sizes = [r["count"] for r in bucketed(counts, [], 64)[1].groupBy("_b").count().collect()]
    assert max(sizes) < 3 * 20_000 / 64
    want = df.agg(F.percentile("x", F.array(F.lit(0.1), F.lit(0.5), F.lit(1.0)))).first()[0]
    assert exact_quantiles(df, "x", [0.1, 0.5, 1.0]).first()[0] == want


def test_auc_of_rare_events_spreads_over_buckets(spark):
    from ruleweave.operators.auc import _bucket, grouped_auc
    df = spark.range(4000).select((F.col("id") / 4_000_000).alias("prob"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    df = df.union(spark.createDataFrame([(0.0, 1), (1.0, 0), (1.0, 1)], "prob double, y int"))
    assert df.select(_bucket(F.col("prob"), 0.0, 1.0, 1024).alias("b")).distinct().count() > 40
    rows = df.collect()
    pos, neg = [r.prob for r in rows if r.y == 0], [r.prob for r in rows if r.y == 1]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(grouped_auc(df, []).first().auc - want) < 1e-9


def test_learning_curve_queries_draw_by_hash(monkeypatch):
    from ruleweave import registry as R
    seen = []
    for name in ("disagreement_table", "evaluation_sets", "training_cases"):
        monkeypatch.setattr(R, name, lambda *a, **k: None)
    monkeypatch.setattr(R.aug, "rule_subsets", lambda *a, **k: {})
    monkeypatch.setattr(R.lc, "learning_curve", lambda *a, **k: seen.append(k) or (None, None))
    R._learning_curve(None, None)
    assert not seen[0].get("modular", False)


def test_hash_samples_of_replicates_are_independent_above_the_modulus(spark):
    from ruleweave.operators.sampling import replicated_samples
    # keys of ten residues only: the modular order takes whole residue classes
    df = spark.range(4000).selectExpr("id % 10 + 1000003 * (id DIV 10) AS case_id", "0 AS y")
    for r in (1, 2):
        got = replicated_samples(df, ["y"], [400], 2).where(f"replicate = {r}").selectExpr("case_id % 1000003 AS k").distinct().count()
        assert got == 10


def test_rulefit_trees_have_the_depth_of_ten_splits(monkeypatch):
    from types import SimpleNamespace

    from ruleweave import registry as R
    seen = []

    class Done(Exception):
        pass

    def rules(*a, **k):
        seen.append(k["max_splits"])
        raise Done

    gbm = SimpleNamespace(stages=[SimpleNamespace(labelsArray=[])])
    monkeypatch.setattr(R, "training_cases", lambda *a: SimpleNamespace(select=lambda *c: None))
    monkeypatch.setattr(R, "materialize", lambda df, name: df)
    monkeypatch.setattr(R.est, "fit_gbt", lambda *a, **k: seen.append(k["max_depth"]) or gbm)
    monkeypatch.setattr(R, "ensemble_rules", rules)
    try:
        R.rulefit(None, None)
    except Done:
        pass
    assert seen == [4, 10]
