"""Rule-defined subpopulations.

The reference loops over rules and data sets and filters the full table each
time (rules × sets scans).  Here the rule hits are exploded once and every
measure is one ``groupBy(rule_id, dataset[, model])``: per-rule aggregation
is partial (map-side) so a rule that covers a third of all cases is no hot
spot – each task emits one partial row per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rules import Rule
from ..operators.auc import grouped_auc
from ..operators.match import ALL_CASES, match_rules


def _grid(spark: SparkSession, rules: Sequence[Rule], datasets: Sequence[str],
          models: Sequence[str] | None = None) -> DataFrame:
    """rule × dataset (× model) key grid built from driver-side parameter
    lists (its size is the product of those list lengths)."""
    if models is None:
        rows = [(r.rule_id, d) for r in rules for d in datasets]
        return spark.createDataFrame(rows, "rule_id string, dataset string")
    rows = [(r.rule_id, d, m) for r in rules for d in datasets for m in models]
    return spark.createDataFrame(rows, "rule_id string, dataset string, model string")


def rule_risk(cases: DataFrame, rules: Sequence[Rule], datasets: Sequence[str],
              event_label: int = 0, digits: int = 6) -> DataFrame:
    """A18 (actual part) + A10: per rule and data set, the number of matched
    cases, the number and share of events, and the coverage in percent of
    the data set.  Input: (case_id, y, dataset).  Rules with no match appear
    with n = 0 and NULL risk.
    """
    spark = cases.sparkSession
    hits = match_rules(cases, rules, keep=("y", "dataset"), with_all_row=True)
    agg = hits.groupBy("rule_id", "dataset").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("y") == F.lit(event_label)).alias("n_event"))
    # The '*' row of each data set carries its total.  The key grid includes
    # it, the aggregate is joined once, and a window over that small table
    # (rules × data sets rows) spreads the total – the case table is scanned
    # once, with no second branch for the totals.
    grid = _grid(spark, [Rule(ALL_CASES)] + list(rules), datasets)
    w = Window.partitionBy("dataset")
    out = (grid.join(agg, ["rule_id", "dataset"], "left")
           .withColumn("n_total", F.max(F.when(F.col("rule_id") == ALL_CASES, F.col("n"))).over(w))
           .filter(F.col("rule_id") != ALL_CASES))
    n = F.coalesce(F.col("n"), F.lit(0)).cast("bigint")
    return out.select(
        "rule_id", "dataset",
        n.alias("n"),
        F.coalesce(F.col("n_event"), F.lit(0)).cast("bigint").alias("n_event"),
        F.round(F.try_divide(F.col("n_event").cast("double"), F.col("n").cast("double")),
                digits).alias("actual_risk"),
        F.round(F.try_divide(n * F.lit(100.0), F.col("n_total").cast("double")),
                digits).alias("coverage_pct"),
    )


def _subpopulations(preds: DataFrame, rules: Sequence[Rule], cases: DataFrame | None,
                    keep: Sequence[str], with_all: bool) -> DataFrame:
    """Prediction rows × the rules they satisfy.  When the prediction rows
    carry the rule features (``cases=None``, the usual case: a model's
    ``transform`` keeps its input columns) the rules are matched on them
    directly – no join.  Otherwise hits are matched on ``cases`` and joined
    on ``case_id``."""
    if cases is None:
        return match_rules(preds, rules, keep=keep, with_all_row=with_all)
    hits = match_rules(cases, rules, keep=("case_id",), with_all_row=with_all)
    return preds.select(*dict.fromkeys(["case_id", *keep])).join(hits, "case_id", "inner")


def rule_model_table(preds: DataFrame, rules: Sequence[Rule], cases: DataFrame | None = None,
                     event_label: int = 0, direction: str = "higher_is_event",
                     digits: int = 6, with_all: bool = False) -> DataFrame:
    """A17 + A18: per (rule, dataset, model) – n, actual event share, mean
    predicted probability and AUC inside the subpopulation.

    ``preds``: long predictions (case_id, y, dataset, model, prob[, features]).
    ``with_all`` adds the whole data set as rule ``'*'`` (same pass).
    n, event share and mean prediction come out of the AUC count flow itself
    (rows with NULL prob or y are not counted).  Every rule has a row for every
    data set and model that has predictions; without a match n is 0 and the
    measures are NULL.
    """
    g = ["rule_id", "dataset", "model"]
    sub = _subpopulations(preds, rules, cases, ["y", "dataset", "model", "prob"], True)
    auc = grouped_auc(sub, g, score="prob", label="y", event_label=event_label,
                      direction=direction, with_means=True)
    table = auc.select(*g, F.col("n"),
                       F.round("event_share", digits).alias("actual"),
                       F.round("mean_score", digits).alias("predicted"),
                       F.round("auc", digits).alias("auc"))
    return _every_rule(table, rules, ["n", "actual", "predicted", "auc"], with_all)


def _every_rule(table: DataFrame, rules: Sequence[Rule], measures: Sequence[str],
                with_all: bool) -> DataFrame:
    """Complete a (rule, dataset, model, measures) table that has the '*' row
    of every data set and model: the measures of each (dataset, model) become
    one map by rule (at most one entry per rule), read for every rule."""
    per = table.groupBy("dataset", "model").agg(F.map_from_entries(F.collect_list(
        F.struct("rule_id", F.struct(*measures).alias("m")))).alias("_m"))
    ids = [r.rule_id for r in rules] + ([ALL_CASES] if with_all else [])
    full = per.select(F.explode(F.array(*[F.lit(i) for i in ids])).alias("rule_id"),
                      "dataset", "model", "_m")
    full = full.withColumn("_v", F.try_element_at("_m", F.col("rule_id")))
    return full.select("rule_id", "dataset", "model", *[
        (F.coalesce(F.col("_v").getField(c), F.lit(0)).cast("bigint") if c == "n"
         else F.col("_v").getField(c)).alias(c) for c in measures])


def model_differences(table: DataFrame, datasets: Sequence[str], models: Sequence[str],
                      base: str, augmented: str, ref_set: str, new_set: str,
                      digits: int = 6) -> DataFrame:
    """One row per rule with the measures of ``rule_model_table`` pivoted
    by data set and model (conditional aggregation with a fixed key list),
    and the reference's difference measures:

    * ``diff_aug_base``   – predicted(augmented) − predicted(base) on ``new_set``;
    * ``did_ref``/``did_new`` – (actual − pred_base) − (actual − pred_aug);
    * ``aug_improvement`` – did_ref − did_new; absolute values of both;
    * ``prop_obs_<set>``  – n · 100 / rows of the set, when the table has the
      whole-set rows (rule ``'*'``, ``rule_model_table(with_all=True)``).
    The table has one row per (rule, set, model); the set totals are spread
    with a window over it and the pivot is one aggregate – a linear flow.
    """
    whole = Window.partitionBy()  # the table is rule-count sized
    table = table.withColumns({
        f"_tot_{d}": F.max(F.when((F.col("rule_id") == ALL_CASES) & (F.col("dataset") == d),
                                  F.col("n"))).over(whole) for d in datasets})
    table = table.filter(F.col("rule_id") != ALL_CASES)
    aggs = [F.max(f"_tot_{d}").alias(f"_tot_{d}") for d in datasets]
    for d in datasets:
        aggs.append(F.coalesce(F.max(F.when(F.col("dataset") == d, F.col("n"))), F.lit(0))
                    .cast("bigint").alias(f"n_{d}"))
        aggs.append(F.max(F.when(F.col("dataset") == d, F.col("actual"))).alias(f"actual_{d}"))
        for m in models:
            sel = (F.col("dataset") == d) & (F.col("model") == m)
            aggs.append(F.max(F.when(sel, F.col("predicted"))).alias(f"pred_{m}_{d}"))
            aggs.append(F.max(F.when(sel, F.col("auc"))).alias(f"auc_{m}_{d}"))
    w = table.groupBy("rule_id").agg(*aggs)

    def did(s):
        return ((F.col(f"actual_{s}") - F.col(f"pred_{base}_{s}"))
                - (F.col(f"actual_{s}") - F.col(f"pred_{augmented}_{s}")))
    w = w.withColumns({
        "diff_aug_base": F.col(f"pred_{augmented}_{new_set}") - F.col(f"pred_{base}_{new_set}"),
        "did_ref": did(ref_set), "did_new": did(new_set)})
    w = w.withColumns({"diff_aug_base_abs": F.abs("diff_aug_base"),
                       "aug_improvement": F.col("did_ref") - F.col("did_new")})
    w = w.withColumn("aug_improvement_abs", F.abs("aug_improvement"))
    # NULL when the table has no whole-set rows
    w = w.withColumns({f"prop_obs_{d}": F.col(f"n_{d}") * F.lit(100.0) / F.col(f"_tot_{d}")
                       for d in datasets})
    w = w.drop(*[f"_tot_{d}" for d in datasets])
    return w.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c)
                      for c, t in w.dtypes])


def selected_rules_report(preds: DataFrame, rules: Sequence[Rule], selected: Sequence[str],
                          cases: DataFrame | None = None, event_label: int = 0,
                          digits: int = 6) -> DataFrame:
    """Per selected rule, data set and model – n, actual event share and
    mean predicted risk – plus an "all cases" row (rule_id '*'), from one
    aggregation pass (the '*' id is emitted once per case by the matcher)."""
    chosen = [r for r in rules if r.rule_id in set(selected)]
    sub = _subpopulations(preds, chosen, cases, ["y", "dataset", "model", "prob"], True)
    g = ["rule_id", "dataset", "model"]
    table = sub.groupBy(*g).agg(
        F.count(F.lit(1)).cast("bigint").alias("n"),
        F.round(F.avg((F.col("y") == F.lit(event_label)).cast("double")), digits).alias("actual"),
        F.round(F.avg("prob"), digits).alias("predicted"))
    return _every_rule(table, chosen, ["n", "actual", "predicted"], True)


def subpopulation_profile(cases: DataFrame, rules: Sequence[Rule], numeric: Sequence[str],
                          categorical: Sequence[str], digits: int = 6,
                          level_orders: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """A24 (+ A6, A8, A9, P17): for every rule and every feature the rule
    uses – categories: mode (ties → last in text order) and the sorted
    distinct levels; numbers: mean, min, max – over the matched cases.

    Hits keep the feature values (no join back to the cases); values are
    gathered to long form per kind and restricted to the rule's own features
    with a semi join on the (rule, feature) map (size: total conditions)."""
    spark = cases.sparkSession
    feats = list(dict.fromkeys(list(numeric) + list(categorical)))
    hits = match_rules(cases, rules, keep=feats)
    rf = spark.createDataFrame([(r.rule_id, f) for r in rules for f in r.features],
                               "rule_id string, feature string")
    nums = [f for f in numeric if f in {x for r in rules for x in r.features}]
    cats = [f for f in categorical if f in {x for r in rules for x in r.features}]
    out = []
    if nums:
        nl = hits.select("rule_id", *[F.col(c).cast("double").alias(c) for c in nums]) \
            .unpivot(["rule_id"], nums, "feature", "num_value")
        nl = nl.join(F.broadcast(rf), ["rule_id", "feature"], "left_semi")
        out.append(nl.groupBy("rule_id", "feature").agg(
            F.lit("numeric").alias("kind"),
            F.lit(None).cast("string").alias("mode"),
            F.lit(None).cast("string").alias("levels"),
            F.round(F.avg("num_value"), digits).alias("mean"),
            F.round(F.min("num_value"), digits).alias("min"),
            F.round(F.max("num_value"), digits).alias("max")))
    if cats:
        cl = hits.select("rule_id", *[F.col(c).cast("string").alias(c) for c in cats]) \
            .unpivot(["rule_id"], cats, "feature", "cat_value")
        cl = cl.join(F.broadcast(rf), ["rule_id", "feature"], "left_semi")
        vc = (cl.filter(F.col("cat_value").isNotNull())
              .groupBy("rule_id", "feature", "cat_value").agg(F.count(F.lit(1)).alias("n")))
        # mode ties: last in level order for ordered categories (their level
        # list), last in text order otherwise – as a stable sort + tail does
        order_key = F.lit(None).cast("int")
        for feat, levels in (level_orders or {}).items():
            order_key = F.when(F.col("feature") == feat,
                               F.array_position(F.array(*[F.lit(v) for v in levels]),
                                                F.col("cat_value")).cast("int")
                               ).otherwise(order_key)
        out.append(vc.groupBy("rule_id", "feature").agg(
            F.lit("category").alias("kind"),
            F.max_by("cat_value", F.struct("n", order_key.alias("lvl"), "cat_value")).alias("mode"),
            F.array_join(F.array_sort(F.collect_list("cat_value")), ", ").alias("levels"),
            F.lit(None).cast("double").alias("mean"),
            F.lit(None).cast("double").alias("min"),
            F.lit(None).cast("double").alias("max")))
    if not out:  # no rule uses a profiled feature
        return spark.createDataFrame([], "rule_id string, feature string, kind string, "
                                         "mode string, levels string, mean double, "
                                         "min double, max double")
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    return res
