"""Registered queries (one per operator of the inventory) and their SQL twins.

Each query takes ``(spark, sf_dir)``, reads the driver tables under
``sf_dir`` and returns a DataFrame.  Double results are rounded to 6 digits
in both the query and its SQL twin so that engines agree to the last bit.
"""

from __future__ import annotations

import contextvars
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .checks import sql as S
from .functions.bins import RISK_BREAKS, RISK_LABELS, equal_width_bins
from .functions.rules import rules_frame
from .functions.tquantile import t975_sql
from .models import estimators as est
from .models.penalty_path import choose_penalty
from .models.tree_rules import ensemble_rules, leaf_rule_scores, leaf_rule_vectors
from .models.tree_scores import with_event_score
from .operators import calibration as cal
from .operators import density as dens
from .operators import reshape as rs
from .operators import sampling as smp
from .operators import stats as st
from .operators.auc import grouped_auc
from .operators.match import match_rules
from .operators.stats import profile
from .plans import augmentation as aug
from .plans import disagreement as dis
from .plans import learning_curve as lc
from .plans import subpopulation as subp
from .plans.subpopulation import rule_model_table, rule_risk
from .session import materialize
from .session import scratch_path
from .sources import report as rep
from .sources import survey as sv
from .sources import testdata as td
from .streaming import scoring as stream_ops

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

DIGITS = 6

# Columns that a query's branches read from the written case table.
_SPLIT_COLS = ("case_id", "start_date", "y")
_SCORE_COLS = (*_SPLIT_COLS, "n_lines", "priority_code")
_RULE_COLS = (*_SPLIT_COLS, *td.CASE_FEATURES)

# Per-query scope for the case table.  Queries whose plans fork (a statistic
# joined back to the rows it came from, splits feeding samples feeding
# models) would rebuild the case table once per branch; for those the case
# table is written once to the shared folder and every branch re-reads it.
# Linear queries keep the single streaming plan from the raw tables.
_CASES: contextvars.ContextVar = contextvars.ContextVar("ruleweave_cases", default=None)


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    scoped = _CASES.get()
    if scoped is not None and scoped[0] == sf_dir:
        return scoped[1]
    return td.cases(spark, sf_dir)


def _scores(spark: SparkSession, sf_dir: str, with_features: bool = False) -> DataFrame:
    return td.scores(spark, sf_dir, with_features=with_features, case_table=_cases(spark, sf_dir))


def register(name: str, sql: str | None = None, reuse_cases: bool | Sequence[str] = False):
    """``reuse_cases``: the case table is written once for all branches of the
    query's plan, with the named columns only (True: all)."""
    def deco(fn):
        if reuse_cases:
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                cases = td.cases(spark, sf_dir)
                if reuse_cases is not True:
                    cases = cases.select(*reuse_cases)
                token = _CASES.set((sf_dir, materialize(cases, "cases")))
                try:
                    return fn(spark, sf_dir)
                finally:
                    _CASES.reset(token)
            run.__doc__, run.__name__ = fn.__doc__, fn.__name__
            QUERIES[name] = run
        else:
            QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _r(c, digits: int = DIGITS):
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


# ---------------------------------------------------------------------------
# Case table, data sets, rule hits
# ---------------------------------------------------------------------------

@register("cases_view", S.with_ctes(S.cases_cte()) + """
SELECT case_id, start_date, y, n_lines, round(avg_qty, 6) AS avg_qty, max_discount,
       round(ship_lag_days, 6) AS ship_lag_days, totalprice, acctbal, priority, priority_code,
       segment, status, region
FROM cases""")
def q_cases_view(spark, sf_dir):
    """S1 + P1/P2/P3/P7: the typed case table built from the stored tables."""
    c = td.cases(spark, sf_dir)
    return c.withColumns({"avg_qty": _r("avg_qty"), "ship_lag_days": _r("ship_lag_days")})


@register("temporal_datasets", S.with_ctes(S.cases_cte(), S.datasets_cte()) + """
SELECT case_id, y, dataset FROM ds""")
def q_temporal_datasets(spark, sf_dir):
    """M4 + P5: train pool / short-term / mid-term membership (overlapping)."""
    return td.with_datasets(td.cases(spark, sf_dir).select("case_id", "y", "start_date")) \
        .select("case_id", "y", "dataset")


@register("rule_hits", S.with_ctes(S.cases_cte(), S.hits_cte(td.RULES, "cases", "case_id")) + """
SELECT case_id, rule_id FROM hits""")
def q_rule_hits(spark, sf_dir):
    """Long (case_id, rule_id) hit table over all cases."""
    return match_rules(td.cases(spark, sf_dir), td.RULES, keep=("case_id",))


def _rule_risk_ctes() -> list[str]:
    rules_vals = S.values_cte("r", "rule_id", [r.rule_id for r in td.RULES])
    ds_vals = S.values_cte("d", "dataset", S.DATASETS)
    return [S.cases_cte(), S.datasets_cte(), S.hits_cte(td.RULES, "ds", "case_id, y, dataset"),
            rules_vals, ds_vals, """
agg AS (SELECT rule_id, dataset, count(*) AS n,
               sum(CASE WHEN y = 0 THEN 1 ELSE 0 END) AS n_event
        FROM hits GROUP BY rule_id, dataset)""", """
tot AS (SELECT dataset, count(*) AS n_total FROM ds GROUP BY dataset)"""]


_RULE_RISK_BODY = """
SELECT r.rule_id, d.dataset,
       CAST(coalesce(a.n, 0) AS BIGINT) AS n,
       CAST(coalesce(a.n_event, 0) AS BIGINT) AS n_event,
       round(a.n_event * 1.0 / a.n, 6) AS actual_risk,
       round(coalesce(a.n, 0) * 100.0 / t.n_total, 6) AS coverage_pct
FROM r CROSS JOIN d
LEFT JOIN agg a ON a.rule_id = r.rule_id AND a.dataset = d.dataset
LEFT JOIN tot t ON t.dataset = d.dataset"""


def _rule_risk_sql() -> str:
    return S.with_ctes(*_rule_risk_ctes()) + _RULE_RISK_BODY


@register("rule_risk", _rule_risk_sql())
def q_rule_risk(spark, sf_dir):
    """A18 (actual) + A10 + A4: per rule and data set – matched cases, events,
    event share and coverage %.  The flagship query."""
    c = td.with_datasets(td.cases(spark, sf_dir))
    return rule_risk(c, td.RULES, S.DATASETS, event_label=0)


# ---------------------------------------------------------------------------
# AUC
# ---------------------------------------------------------------------------

def _auc_sql(direction: str) -> str:
    return S.with_ctes(S.cases_cte(), S.datasets_cte(), S.scores_cte()) + "," + \
        S.auc_sql("preds", ["dataset", "model"], 0, direction) + """
SELECT dataset, model, round(auc, 6) AS auc, n_pos, n_neg FROM _auc"""


@register("auc_by_dataset_model", _auc_sql("higher_is_event"))
def q_auc(spark, sf_dir):
    """Exact tie-aware AUC per (data set, model)."""
    a = grouped_auc(_scores(spark, sf_dir), ["dataset", "model"], event_label=0)
    return a.withColumn("auc", _r("auc"))


@register("auc_auto_direction", _auc_sql("auto"))
def q_auc_auto(spark, sf_dir):
    """A16 with the automatic direction (class medians)."""
    a = grouped_auc(_scores(spark, sf_dir), ["dataset", "model"], event_label=0,
                    direction="auto")
    return a.withColumn("auc", _r("auc"))


def _rule_model_sql() -> str:
    return S.with_ctes(S.cases_cte(), S.datasets_cte(), S.scores_cte(),
                       S.hits_cte(td.RULES, "cases", "case_id", name="h")) + """,
  sub AS (SELECT p.*, h.rule_id FROM preds p JOIN h USING (case_id)),
  base AS (SELECT rule_id, dataset, model, count(*) AS n,
                  avg(CASE WHEN y = 0 THEN 1.0 ELSE 0.0 END) AS actual, avg(prob) AS predicted
           FROM sub GROUP BY ALL),""" + S.auc_sql("sub", ["rule_id", "dataset", "model"]) + """
SELECT r.rule_id, d.dataset, d.model, CAST(coalesce(b.n, 0) AS BIGINT) AS n, round(b.actual, 6) AS actual,
       round(b.predicted, 6) AS predicted, round(a.auc, 6) AS auc
FROM (SELECT * FROM (VALUES """ + ", ".join(f"('{r.rule_id}')" for r in td.RULES) + """) v(rule_id)) r
CROSS JOIN (SELECT DISTINCT dataset, model FROM preds) d
LEFT JOIN base b ON b.rule_id = r.rule_id AND b.dataset = d.dataset AND b.model = d.model
LEFT JOIN _auc a ON a.rule_id = r.rule_id AND a.dataset = d.dataset AND a.model = d.model"""


@register("rule_subpopulation_models", _rule_model_sql())
def q_rule_model(spark, sf_dir):
    """A17 + A18: per (rule, data set, model) – n, actual event share, mean
    predicted risk and AUC inside the rule's subpopulation."""
    return rule_model_table(_scores(spark, sf_dir, True), td.RULES, event_label=0)


# ---------------------------------------------------------------------------
# Bins, calibration, grouped intervals, distributions
# ---------------------------------------------------------------------------


_PREDS = S.with_ctes(S.cases_cte(), S.datasets_cte(), S.scores_cte())


def _calib_long_sql(binned_cte: str) -> str:
    return _PREDS + "," + binned_cte + """,
  w AS (SELECT dataset, model, bin, count(*) AS n, avg(prob) AS Predicted,
               avg(CASE WHEN y = 0 THEN 1.0 ELSE 0.0 END) AS Actual
        FROM b WHERE bin IS NOT NULL GROUP BY ALL)
SELECT dataset, model, bin, CAST(n AS BIGINT) AS n, 'Actual' AS var, round(Actual, 6) AS value FROM w
UNION ALL
SELECT dataset, model, bin, CAST(n AS BIGINT) AS n, 'Predicted' AS var, round(Predicted, 6) AS value FROM w"""


@register("calibration_fixed_bins", _calib_long_sql(
    f"\n  b AS (SELECT *, {S.fixed_bin_sql('prob', RISK_BREAKS, RISK_LABELS)} AS bin FROM preds)"))
def q_calibration_fixed(spark, sf_dir):
    """A11 + A15 + O5: right-closed fixed risk bins (0,.2],…,(.8,1]; per data
    set, model and bin the mean predicted risk and actual event share, long."""
    p = cal.with_fixed_bins(_scores(spark, sf_dir))
    return cal.calibration(p, ["dataset", "model"]).withColumn("value", _r("value"))


@register("calibration_quantile_bins", _calib_long_sql(f"""
  qb AS (SELECT dataset, model, quantile_cont(prob, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS br
         FROM preds GROUP BY ALL),
  b AS (SELECT p.*, CAST({S.count_above_sql('p.prob', 'qb.br', 5)} AS INTEGER) AS bin
        FROM preds p JOIN qb USING (dataset, model))"""), reuse_cases=_SCORE_COLS)
def q_calibration_quantile(spark, sf_dir):
    """A13 + A15: equal-count (quintile) bins per data set and model, then
    the calibration table."""
    p = cal.with_quantile_bins(_scores(spark, sf_dir), ["dataset", "model"], k=5)
    return cal.calibration(p, ["dataset", "model"]).withColumn("value", _r("value"))


@register("equal_width_bins", S.with_ctes(S.cases_cte(), S.datasets_cte()) + """,
  rng AS (SELECT dataset, min(acctbal) AS mn, max(acctbal) AS mx FROM ds GROUP BY dataset),
  b AS (SELECT ds.dataset, acctbal,
               CAST(1 + (CASE WHEN acctbal > mn + 1 * ((mx - mn) / 5) THEN 1 ELSE 0 END)
                      + (CASE WHEN acctbal > mn + 2 * ((mx - mn) / 5) THEN 1 ELSE 0 END)
                      + (CASE WHEN acctbal > mn + 3 * ((mx - mn) / 5) THEN 1 ELSE 0 END)
                      + (CASE WHEN acctbal > mn + 4 * ((mx - mn) / 5) THEN 1 ELSE 0 END) AS INTEGER) AS bin
        FROM ds JOIN rng USING (dataset))
SELECT dataset, bin, CAST(count(*) AS BIGINT) AS n, min(acctbal) AS min_value, max(acctbal) AS max_value
FROM b GROUP BY ALL""", reuse_cases=("case_id", "start_date", "acctbal"))
def q_equal_width_bins(spark, sf_dir):
    """``cut(x, 5)`` equal-width bins of acctbal within each data set."""
    c = td.with_datasets(_cases(spark, sf_dir).select("case_id", "start_date", "acctbal"))
    b = equal_width_bins(c, "acctbal", 5, ["dataset"])
    return b.groupBy("dataset", "bin").agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                                           F.min("acctbal").alias("min_value"),
                                           F.max("acctbal").alias("max_value"))


def _ci_select_sql(src: str, g: str) -> str:
    return f"""
SELECT {g}, round(mean, 6) AS mean, round(sd, 6) AS sd, CAST(n AS BIGINT) AS n, round(se, 6) AS se,
       round(mean - {t975_sql('n - 1')} * se, 6) AS ci_lower,
       round(mean + {t975_sql('n - 1')} * se, 6) AS ci_upper
FROM (SELECT *, sd / sqrt(n) AS se FROM {src})"""


def _round_all(df, keep):
    return df.select(*[F.col(c) if c in keep or dict(df.dtypes)[c] != "double" else _r(c).alias(c)
                       for c in df.columns])


@register("grouped_ci", S.with_ctes(S.cases_cte(), S.datasets_cte()) + """,
  a AS (SELECT dataset, segment, avg(totalprice) AS mean, stddev_samp(totalprice) AS sd,
               count(totalprice) AS n FROM ds GROUP BY ALL)""" + _ci_select_sql("a", "dataset, segment"))
def q_grouped_ci(spark, sf_dir):
    """A2 + A3: mean, sd, n, se and 95 % t interval of totalprice per data set
    and segment (large n: the t quantile comes from the expansion)."""
    c = td.with_datasets(td.cases(spark, sf_dir).select("case_id", "start_date", "totalprice",
                                                       "segment"))
    return _round_all(st.grouped_summary(c, ["dataset", "segment"], "totalprice"), [])


def _rule_risk_cte() -> str:
    """rule_risk as a CTE named _x (same SQL as the rule_risk twin)."""
    return S.with_ctes(*_rule_risk_ctes(), f"\n_x AS ({_RULE_RISK_BODY})") + ","


@register("rule_risk_bin_ci", _rule_risk_cte() + f"""
  rb AS (SELECT dataset, {S.fixed_bin_sql('actual_risk', RISK_BREAKS, RISK_LABELS)} AS bin, actual_risk
         FROM _x),
  a AS (SELECT dataset, bin, avg(actual_risk) AS mean, stddev_samp(actual_risk) AS sd,
               count(actual_risk) AS n FROM rb GROUP BY ALL)""" + _ci_select_sql("a", "dataset, bin"))
def q_rule_risk_bin_ci(spark, sf_dir):
    """A11 + A2 + A3 on the rule table: rules binned by their actual risk,
    mean risk with its 95 % t interval per data set and bin (small n: the
    t table)."""
    rr = q_rule_risk(spark, sf_dir)
    b = cal.with_fixed_bins(rr, prob="actual_risk")
    return _round_all(st.grouped_summary(b, ["dataset", "bin"], "actual_risk"), [])


@register("box_stats", _PREDS + """,
  q AS (SELECT dataset, model, quantile_cont(prob, [0.25, 0.5, 0.75]) AS qq FROM preds GROUP BY ALL),
  j AS (SELECT p.*, qq[1] AS q1, qq[2] AS median, qq[3] AS q3 FROM preds p JOIN q USING (dataset, model)),
  k AS (SELECT *, prob >= q1 - 1.5 * (q3 - q1) AND prob <= q3 + 1.5 * (q3 - q1) AS inside FROM j)
SELECT dataset, model, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       round(min(CASE WHEN inside THEN prob END), 6) AS whisker_low,
       round(max(CASE WHEN inside THEN prob END), 6) AS whisker_high,
       CAST(sum(CASE WHEN inside THEN 0 ELSE 1 END) AS BIGINT) AS n_outliers,
       round(avg(prob), 6) AS mean, CAST(count(*) AS BIGINT) AS n
FROM k GROUP BY dataset, model, q1, median, q3""", reuse_cases=_SCORE_COLS)
def q_box_stats(spark, sf_dir):
    """Box-plot statistics (+ mean) of predicted risk per data set and model."""
    return _round_all(st.box_stats(_scores(spark, sf_dir), ["dataset", "model"], "prob"), [])


@register("histogram_density", _PREDS + """,
  b AS (SELECT dataset, model, CAST(greatest(ceil((prob - 0.0) / 0.05), 1) AS INTEGER) AS bin
        FROM preds WHERE prob IS NOT NULL AND prob >= 0.0 AND prob <= 1.0),
  c AS (SELECT dataset, model, bin, count(*) AS cnt FROM b GROUP BY ALL),
  t AS (SELECT dataset, model, sum(cnt) AS n FROM c GROUP BY ALL)
SELECT dataset, model, bin, round(0.0 + (bin - 1) * 0.05, 6) AS x_lo, round(0.0 + bin * 0.05, 6) AS x_hi,
       CAST(cnt AS BIGINT) AS count, round(cnt / (n * 0.05), 6) AS density
FROM c JOIN t USING (dataset, model)""")
def q_histogram_density(spark, sf_dir):
    """Histogram-as-density of predicted risk (20 bins on [0,1])."""
    h = dens.histogram_density(_scores(spark, sf_dir), ["dataset", "model"], "prob", 0.0, 1.0, 20)
    return _round_all(h, [])


_KDE_N = 64
_KDE_STEP = 1.0 / (_KDE_N - 1)


@register("kde_grid", _PREDS + f""",
  bwq AS (SELECT dataset, model, quantile_cont(prob, [0.25, 0.75]) AS q, count(*) AS n,
                 stddev_samp(prob) AS sd FROM preds WHERE prob IS NOT NULL GROUP BY ALL),
  bw AS (SELECT dataset, model, n,
                0.9 * (CASE WHEN least(sd, (q[2] - q[1]) / 1.34) > 0 THEN least(sd, (q[2] - q[1]) / 1.34)
                            WHEN sd > 0 THEN sd ELSE 1.0 END) * pow(CAST(n AS DOUBLE), -0.2) AS bandwidth
         FROM bwq),
  grid AS (SELECT range AS gi FROM range(0, {_KDE_N})),
  d AS (SELECT p.dataset, p.model, g.gi,
               sum(exp(-0.5 * pow((0.0 + g.gi * {_KDE_STEP!r} - p.prob) / bw.bandwidth, 2.0))) AS s
        FROM preds p JOIN bw USING (dataset, model) CROSS JOIN grid g WHERE p.prob IS NOT NULL GROUP BY ALL)
SELECT d.dataset, d.model, CAST(d.gi AS INTEGER) AS grid_index, round(0.0 + d.gi * {_KDE_STEP!r}, 6) AS x,
       round(d.s * {1.0 / (2 * 3.141592653589793) ** 0.5!r} / (bw.n * bw.bandwidth), 6) AS density,
       round(bw.bandwidth, 6) AS bandwidth
FROM d JOIN bw USING (dataset, model)""", reuse_cases=_SCORE_COLS)
def q_kde_grid(spark, sf_dir):
    """Gaussian KDE (bw.nrd0) of predicted risk on a 64-point grid."""
    k = dens.kde_grid(_scores(spark, sf_dir), ["dataset", "model"], "prob", 0.0, 1.0, _KDE_N)
    return _round_all(k, [])


# ---------------------------------------------------------------------------
# Sampling and splits
# ---------------------------------------------------------------------------


SPLIT_SEED = 69
TEST_SEED = 70
# The training-set sizes and replicates of the learning curve.
LC_SIZES = [250, 500, 1000, 2000, 4000, 8000, 16000]
LC_REPLICATES = 5


def _split_sql_ctes() -> list[str]:
    return [S.cases_cte()] + S.split_ctes(smp.modular_order_sql("case_id", str(SPLIT_SEED)))


def train_pool(spark, sf_dir):
    c = _cases(spark, sf_dir)
    return c.filter(F.col("start_date") < F.lit(td.TRAIN_POOL_BEFORE).cast("date"))


def split_pool(spark, sf_dir):
    """M1 on the train pool: 20 % train (stratified by y), rest test."""
    return smp.stratified_split(train_pool(spark, sf_dir), ["y"], 0.2, "case_id",
                                order=smp.modular_order("case_id", SPLIT_SEED))


def training_cases(spark, sf_dir):
    return split_pool(spark, sf_dir).filter(F.col("split") == "train").drop("split")


@register("stratified_split", S.with_ctes(*_split_sql_ctes()) + """
SELECT case_id, y, split FROM split""", reuse_cases=_SPLIT_COLS)
def q_stratified_split(spark, sf_dir):
    """M1 + M6 + P5: exact stratified 20 % train / 80 % test split of the
    train pool by y, seeded hash order."""
    return split_pool(spark, sf_dir).select("case_id", "y", "split")


@register("test_sample", S.with_ctes(*_split_sql_ctes()) + f""",
  rest AS (SELECT * FROM pool WHERE case_id NOT IN (SELECT case_id FROM train)),
  rs AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY
                   {smp.modular_order_sql('case_id', str(TEST_SEED))}, case_id) AS rk2,
                count(*) OVER (PARTITION BY segment) AS n_seg FROM rest)
SELECT case_id, y, segment FROM rs WHERE rk2 <= round_even(0.1 * n_seg, 0)""", reuse_cases=(*_SPLIT_COLS, "segment"))
def q_test_sample(spark, sf_dir):
    """J3 + M2: train-pool cases not in the training split (anti join), then
    an exact 10 % sample per segment (round half to even)."""
    rest = smp.exclude(train_pool(spark, sf_dir), training_cases(spark, sf_dir), "case_id")
    s = smp.stratified_fraction(rest, ["segment"], 0.1, "case_id",
                                order=smp.modular_order("case_id", TEST_SEED))
    return s.select("case_id", "y", "segment")


@register("stratified_n_per_class", S.with_ctes(*_split_sql_ctes()) + f""",
  r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY
                  {smp.modular_order_sql('case_id', str(TEST_SEED))}, case_id) AS rk3 FROM train)
SELECT case_id, y FROM r WHERE rk3 <= 400""", reuse_cases=_SPLIT_COLS)
def q_stratified_n(spark, sf_dir):
    """M3: 400 training cases per class (all of a smaller class)."""
    s = smp.stratified_n(training_cases(spark, sf_dir), ["y"], 400, "case_id",
                         order=smp.modular_order("case_id", TEST_SEED))
    return s.select("case_id", "y")


@register("learning_curve_samples", S.with_ctes(*_split_sql_ctes()) + f""",
  rep AS (SELECT t.*, r.replicate FROM train t CROSS JOIN (SELECT range AS replicate FROM range(1, {LC_REPLICATES + 1})) r),
  rk AS (SELECT *, row_number() OVER (PARTITION BY y, replicate ORDER BY
                   {smp.modular_order_sql('case_id', f'{SPLIT_SEED} + replicate')}, case_id) AS rk4 FROM rep),
  g AS (SELECT * FROM (VALUES {', '.join(f'({n // 2})' for n in LC_SIZES)}) s(n_per_stratum))
SELECT CAST(replicate AS INTEGER) AS replicate, CAST(2 * n_per_stratum AS INTEGER) AS n_train, case_id, y
FROM rk JOIN g ON rk.rk4 <= g.n_per_stratum""", reuse_cases=_SPLIT_COLS)
def q_learning_curve_samples(spark, sf_dir):
    """M5: the learning-curve sample grid – 7 sizes × 5 replicates, n/2 cases
    per class each, one seeded order per replicate."""
    s = smp.replicated_samples(training_cases(spark, sf_dir), ["y"], [n // 2 for n in LC_SIZES],
                               LC_REPLICATES, "case_id", seed=SPLIT_SEED, modular=True)
    return s.select(F.col("replicate").cast("int"),
                    (F.col("n_per_stratum") * 2).cast("int").alias("n_train"), "case_id", "y")


# ---------------------------------------------------------------------------
# Survey and expert disagreement
# ---------------------------------------------------------------------------


RATED = [f"R{i}" for i in range(1, td.N_RATED_RULES + 1)]


def survey_answers(spark, sf_dir):
    """Survey answers read back from CSV (S2), long and recoded."""
    path = scratch_path(spark, "survey-csv")
    sv.write_survey_csv(td.survey_wide(spark, sf_dir), path)
    wide = sv.read_survey_csv(spark, path, RATED)
    return sv.recode_answers(sv.answers_long(wide, RATED), td.LIKERT_SCORES)


_SURVEY_SQL = S.survey_ctes()


@register("survey_answers", S.with_ctes(*_SURVEY_SQL) + """
SELECT expert_id, rule_id, answer_text, answer FROM ans""")
def q_survey_answers(spark, sf_dir):
    """S2 + O5 + P6 + P7 + P10: the wide survey written to and read from CSV
    with a fixed schema, gathered to long form, Likert text recoded to
    scores ("don't know" → NULL)."""
    return survey_answers(spark, sf_dir).filter(F.col("answer_text").isNotNull())


@register("expert_summary", S.with_ctes(*_SURVEY_SQL) + """
SELECT rule_id, round(expert_assessment, 6) AS expert_assessment, round(ea_sd, 6) AS ea_sd, n_experts FROM ex""")
def q_expert_summary(spark, sf_dir):
    """A1: per rated rule the experts' mean score, sd and answer count."""
    e = dis.expert_summary(survey_answers(spark, sf_dir))
    return _round_all(e, [])


def _facts_sql() -> list[str]:
    return [S.hits_cte(td.RULES, "train", "case_id, y", name="th"),
            S.values_cte("fr", "rule_id", [r.rule_id for r in td.RULES]), """
facts AS (SELECT fr.rule_id, CAST(count(th.rule_id) AS BIGINT) AS n_train,
                 avg(CASE WHEN th.y = 0 THEN 1.0 WHEN th.y IS NOT NULL THEN 0.0 END) AS empirical_risk
          FROM fr LEFT JOIN th ON th.rule_id = fr.rule_id GROUP BY fr.rule_id)"""]


def training_facts(spark, sf_dir):
    return dis.rule_facts(training_cases(spark, sf_dir), td.RULES, event_label=0)


@register("rule_facts", S.with_ctes(*_split_sql_ctes(), *_facts_sql()) + """
SELECT rule_id, n_train, round(empirical_risk, 6) AS empirical_risk FROM facts""", reuse_cases=_RULE_COLS)
def q_rule_facts(spark, sf_dir):
    """Per rule the matched training cases and empirical risk."""
    return _round_all(training_facts(spark, sf_dir), [])


def _disagreement_sql_ctes() -> list[str]:
    return [*_split_sql_ctes(), *_facts_sql(), *_SURVEY_SQL, f"""
j AS (SELECT ex.*, CAST(coalesce(f.n_train, 0) AS BIGINT) AS n_train, f.empirical_risk,
             ea_sd / sqrt(n_experts) AS se,
             f.empirical_risk - expert_assessment AS vahe,
             abs(f.empirical_risk - expert_assessment) AS abs_vahe,
             CASE WHEN ea_sd = 0 THEN NULL ELSE abs(f.empirical_risk - expert_assessment) / ea_sd END AS abs_vahe_x_stdv,
             {S.fixed_bin_sql('f.empirical_risk', RISK_BREAKS, RISK_LABELS)} AS risk_bin
      FROM ex LEFT JOIN facts f USING (rule_id))""", """
rng AS (SELECT min(abs_vahe_x_stdv) AS mn, max(abs_vahe_x_stdv) AS mx FROM j)""", """
dj AS (SELECT j.*, CAST(CASE WHEN abs_vahe_x_stdv IS NULL THEN NULL
                   WHEN mx - mn = 0 THEN 3
                   ELSE 1 + (CASE WHEN abs_vahe_x_stdv > mn + 1 * ((mx - mn) / 5) THEN 1 ELSE 0 END)
                          + (CASE WHEN abs_vahe_x_stdv > mn + 2 * ((mx - mn) / 5) THEN 1 ELSE 0 END)
                          + (CASE WHEN abs_vahe_x_stdv > mn + 3 * ((mx - mn) / 5) THEN 1 ELSE 0 END)
                          + (CASE WHEN abs_vahe_x_stdv > mn + 4 * ((mx - mn) / 5) THEN 1 ELSE 0 END) END AS INTEGER) AS penalty_rank
       FROM j CROSS JOIN rng)"""]


def disagreement_table(spark, sf_dir):
    e = dis.expert_summary(survey_answers(spark, sf_dir))
    return dis.disagreement(e, training_facts(spark, sf_dir))


@register("expert_disagreement", S.with_ctes(*_disagreement_sql_ctes()) + f"""
SELECT rule_id, round(expert_assessment, 6) AS expert_assessment, round(ea_sd, 6) AS ea_sd, n_experts, n_train,
       round(empirical_risk, 6) AS empirical_risk, round(se, 6) AS se,
       round(expert_assessment - {t975_sql('n_experts - 1')} * se, 6) AS ci_lower,
       round(expert_assessment + {t975_sql('n_experts - 1')} * se, 6) AS ci_upper,
       risk_bin, round(vahe, 6) AS vahe, round(abs_vahe, 6) AS abs_vahe,
       round(abs_vahe_x_stdv, 6) AS abs_vahe_x_stdv, CAST(penalty_rank AS DOUBLE) AS penalty_rank
FROM dj""", reuse_cases=_RULE_COLS)
def q_expert_disagreement(spark, sf_dir):
    """R11 (+ A1, J2, A3, P8, A11, A12, A14): expert vs empirical risk per
    rated rule, 95 % interval of the expert mean, |Δrisk| / sd and the
    penalty rank (equal-width bin of it).  penalty_rank is emitted as double
    here (NULL for unranked rules; a nullable int column converts to pandas
    differently between engines)."""
    d = disagreement_table(spark, sf_dir)
    return _round_all(d.withColumn("penalty_rank", F.col("penalty_rank").cast("double")), [])


@register("kept_rules", S.with_ctes(*_disagreement_sql_ctes(),
                                    S.values_cte("allr", "rule_id", [r.rule_id for r in td.RULES])) + """
SELECT CAST(k.k AS INTEGER) AS k, a.rule_id
FROM allr a LEFT JOIN dj USING (rule_id) CROSS JOIN (SELECT range AS k FROM range(1, 5)) k
WHERE dj.penalty_rank IS NULL OR dj.penalty_rank <= k.k""", reuse_cases=_RULE_COLS)
def q_kept_rules(spark, sf_dir):
    """P12 + J2 (R12 selection): for k = 1..4 the rules kept in the
    expert-augmented model – penalty rank ≤ k or not rated."""
    ranks = disagreement_table(spark, sf_dir)
    allr = rules_frame(spark, td.RULES)
    ks = allr.select("rule_id", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("k"))
    j = ks.join(ranks.select("rule_id", "penalty_rank"), "rule_id", "left")
    return j.filter(F.col("penalty_rank").isNull() | (F.col("penalty_rank") <= F.col("k"))) \
        .select(F.col("k").cast("int"), "rule_id")


@register("expert_importance", S.with_ctes(*_SURVEY_SQL, S.rule_features_cte(td.RULES)) + """,
  f AS (SELECT rule_id, unnest(features) AS feature, len(features) AS nf FROM rf),
  imp AS (SELECT feature, avg(abs(0.5 - expert_assessment) / nf) AS importance
          FROM f JOIN ex USING (rule_id) GROUP BY feature),
  mm AS (SELECT min(importance) AS mn, max(importance) AS mx FROM imp),
  sc AS (SELECT feature, importance,
                CASE WHEN mx - mn = 0 THEN NULL ELSE (importance - mn) / (mx - mn) END AS scaled
         FROM imp CROSS JOIN mm)
SELECT feature, round(importance, 6) AS importance, round(scaled, 6) AS scaled,
       CAST(dense_rank() OVER (ORDER BY scaled DESC) AS INTEGER) AS imp_rank
FROM sc""")
def q_expert_importance(spark, sf_dir):
    """A25 + A7 + W1 + O7: feature importance implied by expert ratings,
    min–max scaled and ranked."""
    e = dis.expert_summary(survey_answers(spark, sf_dir))
    rf = rules_frame(spark, td.RULES)
    out = dis.expert_importance(e, rf).withColumnRenamed("order", "imp_rank")
    return _round_all(out, [])


# ---------------------------------------------------------------------------
# Subpopulation differences, selected-rule report, subpopulation profile,
# data profile
# ---------------------------------------------------------------------------


MODELS = list(td.SCORE_MODELS)
SELECTED_RULES = ["R1", "R4", "R7", "R16", "R21"]


def _diff_sql() -> str:
    head = _rule_model_sql().replace("\nSELECT r.rule_id", ",\n  rmt AS (SELECT r.rule_id", 1)
    head += "),\n  tot AS (SELECT dataset, count(*) AS n_total FROM ds GROUP BY dataset),"
    cols = []
    for d in S.DATASETS:
        cols.append(f"CAST(coalesce(max(CASE WHEN dataset = '{d}' THEN n END), 0) AS BIGINT) AS n_{d}")
        cols.append(f"max(CASE WHEN dataset = '{d}' THEN actual END) AS actual_{d}")
        for m in MODELS:
            cols.append(f"max(CASE WHEN dataset = '{d}' AND model = '{m}' THEN predicted END) AS pred_{m}_{d}")
            cols.append(f"max(CASE WHEN dataset = '{d}' AND model = '{m}' THEN auc END) AS auc_{m}_{d}")
    base, aug, ref, new = "m1", "m2", "train_pool", "short_term"

    def did(s):
        return f"((actual_{s} - pred_{base}_{s}) - (actual_{s} - pred_{aug}_{s}))"
    tots = ", ".join(f"(SELECT n_total FROM tot WHERE dataset = '{d}') AS _tot_{d}" for d in S.DATASETS)
    out = ["rule_id"]
    for d in S.DATASETS:
        out.append(f"n_{d}")
        out.append(f"round(actual_{d}, 6) AS actual_{d}")
        for m in MODELS:
            out.append(f"round(pred_{m}_{d}, 6) AS pred_{m}_{d}")
            out.append(f"round(auc_{m}_{d}, 6) AS auc_{m}_{d}")
    out += [f"round(pred_{aug}_{new} - pred_{base}_{new}, 6) AS diff_aug_base",
            f"round({did(ref)}, 6) AS did_ref", f"round({did(new)}, 6) AS did_new",
            f"round(abs(pred_{aug}_{new} - pred_{base}_{new}), 6) AS diff_aug_base_abs",
            f"round({did(ref)} - {did(new)}, 6) AS aug_improvement",
            f"round(abs({did(ref)} - {did(new)}), 6) AS aug_improvement_abs"]
    out += [f"round(n_{d} * 100.0 / _tot_{d}, 6) AS prop_obs_{d}" for d in S.DATASETS]
    return head + f"""
  w AS (SELECT rule_id, {', '.join(cols)} FROM rmt GROUP BY rule_id)
SELECT {', '.join(out)} FROM (SELECT w.*, {tots} FROM w)"""


@register("rule_model_differences", _diff_sql())
def q_rule_model_differences(spark, sf_dir):
    """A19 (+ A10): per rule, the subpopulation measures pivoted by data set
    and model, model/data-set differences and coverage %."""
    preds = _scores(spark, sf_dir, True)
    t = subp.rule_model_table(preds, td.RULES, event_label=0, with_all=True)
    return subp.model_differences(t, S.DATASETS, MODELS, "m1", "m2", "train_pool", "short_term")


@register("selected_rules_report", S.with_ctes(
    S.cases_cte(), S.datasets_cte(), S.scores_cte(),
    S.hits_cte([r for r in td.RULES if r.rule_id in SELECTED_RULES], "cases", "case_id", name="h0")) + """,
  h AS (SELECT * FROM h0 UNION ALL SELECT case_id, '*' AS rule_id FROM cases),
  a AS (SELECT rule_id, dataset, model, count(*) AS n,
               avg(CASE WHEN y = 0 THEN 1.0 ELSE 0.0 END) AS actual, avg(prob) AS predicted
        FROM preds JOIN h USING (case_id) GROUP BY ALL)
SELECT r.rule_id, d.dataset, d.model, CAST(coalesce(a.n, 0) AS BIGINT) AS n,
       round(a.actual, 6) AS actual, round(a.predicted, 6) AS predicted
FROM (SELECT * FROM (VALUES ('*'), """ + ", ".join(f"('{r}')" for r in SELECTED_RULES) + """) v(rule_id)) r
CROSS JOIN (SELECT DISTINCT dataset, model FROM preds) d
LEFT JOIN a ON a.rule_id = r.rule_id AND a.dataset = d.dataset AND a.model = d.model""")
def q_selected_rules_report(spark, sf_dir):
    """The report for a few named rules plus an "all cases" row (one pass)."""
    return subp.selected_rules_report(_scores(spark, sf_dir, True), td.RULES,
                                      SELECTED_RULES, event_label=0)


def _profile_sql() -> str:
    parts = []
    for r in td.RULES:
        for f in r.features:
            if f in td.NUMERIC_FEATURES:
                parts.append(f"""  SELECT '{r.rule_id}' AS rule_id, '{f}' AS feature, 'numeric' AS kind,
         CAST(NULL AS VARCHAR) AS mode, CAST(NULL AS VARCHAR) AS levels,
         round(avg(CAST({f} AS DOUBLE)), 6) AS mean, round(min(CAST({f} AS DOUBLE)), 6) AS min,
         round(max(CAST({f} AS DOUBLE)), 6) AS max
  FROM train WHERE {r.to_sql()} HAVING count(*) > 0""")
            else:
                parts.append(f"""  SELECT '{r.rule_id}' AS rule_id, '{f}' AS feature, 'category' AS kind,
         (SELECT v FROM (SELECT {f} AS v, count(*) AS n FROM train WHERE ({r.to_sql()}) AND {f} IS NOT NULL
                         GROUP BY {f}) ORDER BY n DESC, v DESC LIMIT 1) AS mode,
         string_agg(DISTINCT {f}, ', ' ORDER BY {f}) AS levels,
         CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max
  FROM train WHERE ({r.to_sql()}) AND {f} IS NOT NULL HAVING count(*) > 0""")
    return S.with_ctes(*_split_sql_ctes()) + "\n" + "\nUNION ALL\n".join(parts)


@register("subpopulation_profile", _profile_sql(), reuse_cases=True)
def q_subpopulation_profile(spark, sf_dir):
    """A24 (+ A6, A8, A9, O3, P17): per rule and rule feature, over the
    matched training cases – mode and levels of categories; mean, min, max
    of numbers."""
    return subp.subpopulation_profile(training_cases(spark, sf_dir), td.RULES,
                                      td.NUMERIC_FEATURES, td.NOMINAL_FEATURES)


_PROFILE_COLS = [("case_id", "bigint"), ("start_date", "date"), ("y", "int"), ("n_lines", "int"),
                 ("avg_qty", "double"), ("max_discount", "double"), ("ship_lag_days", "double"),
                 ("totalprice", "double"), ("acctbal", "double"), ("priority", "string"),
                 ("priority_code", "int"), ("segment", "string"), ("status", "string"),
                 ("region", "string")]


def _data_profile_sql() -> str:
    parts = []
    for c, t in _PROFILE_COLS:
        numeric = t in ("bigint", "int", "double")
        mn = f"round(CAST(min({c}) AS DOUBLE), 6)" if numeric else "CAST(NULL AS DOUBLE)"
        mx = f"round(CAST(max({c}) AS DOUBLE), 6)" if numeric else "CAST(NULL AS DOUBLE)"
        mnt = "CAST(NULL AS VARCHAR)" if t == "double" else f"CAST(min({c}) AS VARCHAR)"
        mxt = "CAST(NULL AS VARCHAR)" if t == "double" else f"CAST(max({c}) AS VARCHAR)"
        parts.append(f"""  SELECT '{c}' AS "column", '{t}' AS type, CAST(count(*) AS BIGINT) AS n_rows,
         CAST(count(*) - count({c}) AS BIGINT) AS n_null, CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct,
         {mn} AS min_num, {mx} AS max_num, {mnt} AS min_text, {mxt} AS max_text,
         count(DISTINCT {c}) <= 1 AS constant FROM cases""")
    return S.with_ctes(S.cases_cte()) + "\n" + "\nUNION ALL\n".join(parts)


@register("data_profile", _data_profile_sql())
def q_data_profile(spark, sf_dir):
    """Profile of the case table – per column type, rows, NULLs,
    distinct values, min/max, constant flag."""
    p = profile(td.cases(spark, sf_dir).select(*[c for c, _ in _PROFILE_COLS]))
    return p.withColumns({"min_num": _r("min_num"), "max_num": _r("max_num")})


# ---------------------------------------------------------------------------
# Models (no SQL twin: fits are iterative; the driver checks rows only,
# tests/test_models.py checks properties)
# ---------------------------------------------------------------------------


NUM = td.NUMERIC_FEATURES
CAT = td.NOMINAL_FEATURES
CONFOUNDER_DROP = ["R1", "R4", "R7"]
EVAL_SETS = ["test", "short_term", "mid_term"]
# Fixed value: trees of every ensemble (forest trees, boosting rounds).
TREES = 500


def test_cases(spark, sf_dir):
    """Full case rows of the test sample (J3 + M2)."""
    ids = q_test_sample(spark, sf_dir).select("case_id")
    return smp.keep_ids(train_pool(spark, sf_dir), ids, "case_id")


def evaluation_sets(spark, sf_dir):
    """The three evaluation sets: pool hold-out sample, short-term and
    mid-term future (case rows + ``dataset``)."""
    fut = td.with_datasets(_cases(spark, sf_dir)).filter(F.col("dataset") != "train_pool")
    return test_cases(spark, sf_dir).withColumn("dataset", F.lit("test")).unionByName(fut)


def _training_rows(spark, sf_dir):
    """The training split with the models' columns, written once: a fit reads its
    rows several times (categories, medians, bins, trees)."""
    return materialize(training_cases(spark, sf_dir).select("case_id", "y", *NUM, *CAT), "model-train")


def _scores_out(spark, sf_dir, model):
    scored = with_event_score(est.as_double(evaluation_sets(spark, sf_dir), NUM), model)
    return est.event_class(scored, "prob").select("case_id", "dataset", F.col("y").cast("int"),
                                                  "prob", F.col("estimate").cast("int"))


@register("random_forest_scores", reuse_cases=True)
def q_random_forest_scores(spark, sf_dir):
    """R1 + S3 + R9 + R10: random forest on the training split with the
    per-split feature count tuned on a validation split (AUC), saved to the
    shared folder and loaded back, scoring the three evaluation sets
    (P(event) and class)."""
    m = est.fit_random_forest(_training_rows(spark, sf_dir), NUM, CAT, num_trees=TREES,
                              tune_subsets=["3", "5", "10"])
    path = scratch_path(spark, "rf-model")
    est.save_model(m, path)
    return _scores_out(spark, sf_dir, est.load_model(path))


@register("random_forest_importance", reuse_cases=True)
def q_random_forest_importance(spark, sf_dir):
    """A26 + A7: random-forest feature importance, min–max scaled."""
    m = est.fit_random_forest(_training_rows(spark, sf_dir), NUM, CAT, num_trees=TREES)
    return est.feature_importance(m, NUM, CAT)


@register("gbm_scores", reuse_cases=True)
def q_gbm_scores(spark, sf_dir):
    """R2 + R9 + R10: gradient-boosted trees on the training split, scoring
    the evaluation sets."""
    m = est.fit_gbt(_training_rows(spark, sf_dir), NUM, CAT, max_iter=TREES, step=0.01,
                    max_depth=4)
    return _scores_out(spark, sf_dir, m)


# Splits of a tree of the rule ensemble, and the lasso's penalties.
RULE_SPLITS = 10
LASSO_PENALTIES = (0.032, 0.008, 0.002, 0.0005)


def rulefit(spark, sf_dir):
    """R3 + A27 + R5: boosted trees (half-sampled, class-balanced), cut to ten
    splits best-first → all node rules → rule vectors from leaf numbers → lasso
    along its penalties (by AUC over three folds) → the selected rules.  Returns
    (training rows, the boosted trees, their rules, the chosen step)."""
    train = _training_rows(spark, sf_dir)
    gbm = est.fit_gbt(train, NUM, CAT, max_iter=TREES, step=0.001, max_depth=4, subsample=0.5,
                      balanced=True)
    labels = dict(zip(CAT, gbm.stages[0].labelsArray))
    found = ensemble_rules(spark, gbm, NUM + CAT, labels, max_splits=RULE_SPLITS)
    vectors = leaf_rule_vectors(est.with_label(est.as_double(train, NUM)), gbm, found, ["case_id", "label"])
    matrix = materialize(vectors, "rulefit-matrix")
    step, _ = choose_penalty(matrix, len(found.rules), LASSO_PENALTIES, 3, est.key_fold("case_id", 3, 69))
    return train, gbm, found, step


@register("rulefit_rules", reuse_cases=True)
def q_rulefit_rules(spark, sf_dir):
    """R3 + R5 + R6: rules extracted from a boosted ensemble, kept by the
    lasso (non-zero coefficient), with their training empirical risk."""
    train, _, found, step = rulefit(spark, sf_dir)
    kept = [(r, float(c)) for r, c in zip(found.rules, step.coefficients) if c != 0.0]
    coefs = spark.createDataFrame([(r.rule_id, c) for r, c in kept], "rule_id string, coefficient double")
    facts = dis.rule_facts(train, [r for r, _ in kept], event_label=0, coefficients=coefs)
    text = spark.createDataFrame([(r.rule_id, r.text(), len(r.conditions)) for r, _ in kept],
                                 "rule_id string, rule_text string, n_conditions int")
    return text.join(facts, "rule_id", "left").select(
        "rule_id", "rule_text", "n_conditions", "coefficient", "empirical_risk",
        F.coalesce(F.col("n_train"), F.lit(0)).cast("bigint").alias("n_train"))


@register("rulefit_auc", reuse_cases=True)
def q_rulefit_auc(spark, sf_dir):
    """R8 + A16: the full rule ensemble (lasso on all extracted rules) scored
    on the evaluation sets by leaf numbers; AUC per set."""
    _, gbm, found, step = rulefit(spark, sf_dir)
    scored = leaf_rule_scores(est.as_double(evaluation_sets(spark, sf_dir), NUM), gbm, found,
                              step.intercept, step.coefficients, ["case_id", "y", "dataset"])
    return grouped_auc(scored.withColumn("model", F.lit("rulefit")), ["model", "dataset"], event_label=0)


def _ridge_models(spark, sf_dir):
    ranks = disagreement_table(spark, sf_dir)
    subsets = aug.rule_subsets(td.RULES, ranks, ks=(1, 2, 3, 4), drop=CONFOUNDER_DROP)
    models = aug.fit_models(training_cases(spark, sf_dir), subsets, reg_params=(0.001, 0.01, 0.1))
    return subsets, models


@register("augmented_models_auc", reuse_cases=True)
def q_augmented_models_auc(spark, sf_dir):
    """R7 + R12 + R13 + A16: ridge on all rules, the expert-augmented
    models (rank ≤ k, k = 1..4, unrated kept) and the confounder model; AUC
    of each on each evaluation set."""
    subsets, models = _ridge_models(spark, sf_dir)
    scored = aug.score_models(evaluation_sets(spark, sf_dir), models, ["case_id", "y", "dataset"])
    auc = grouped_auc(scored, ["model", "dataset"], event_label=0)
    n_rules = spark.createDataFrame([(k, len(v)) for k, v in subsets.items()],
                                    "model string, n_rules int")
    return auc.join(n_rules, "model", "left")


@register("augmented_calibration", reuse_cases=True)
def q_augmented_calibration(spark, sf_dir):
    """R15 (ridge family only) + A13 + A15: calibration (quintile bins per model and set) of the
    ridge and expert-augmented models."""
    _, models = _ridge_models(spark, sf_dir)
    scored = aug.score_models(evaluation_sets(spark, sf_dir), models, ["case_id", "y", "dataset"])
    b = cal.with_quantile_bins(scored, ["model", "dataset"], k=5)
    return cal.calibration(b, ["model", "dataset"])


def _learning_curve(spark, sf_dir):
    ranks = disagreement_table(spark, sf_dir)
    subsets = aug.rule_subsets(td.RULES, ranks, ks=(1, 2, 3, 4), drop=CONFOUNDER_DROP)
    variants = {k: [r.rule_id for r in v] for k, v in subsets.items()}
    tests = evaluation_sets(spark, sf_dir)
    return lc.learning_curve(training_cases(spark, sf_dir), tests, td.RULES, variants,
                             LC_SIZES, LC_REPLICATES, seed=SPLIT_SEED,
                             forest=(NUM, CAT), forest_trees=TREES)


@register("learning_curve_auc", reuse_cases=True)
def q_learning_curve_auc(spark, sf_dir):
    """R14 + M5 + R1: AUC of every (variant, size, replicate) cell on every
    evaluation set, with the rows and events that the sample really holds; all
    cells are Spark ML fits, submitted side by side."""
    return _learning_curve(spark, sf_dir)[0]


@register("learning_curve_summary", reuse_cases=True)
def q_learning_curve_summary(spark, sf_dir):
    """R14 + W2/A2/A3 + O6: mean AUC with its 95 % t interval per variant,
    size and evaluation set."""
    return _learning_curve(spark, sf_dir)[1]


# ---------------------------------------------------------------------------
# Streaming
# ---------------------------------------------------------------------------


@register("streaming_rule_counts", S.with_ctes(S.cases_cte(), S.hits_cte(td.RULES, "cases", "case_id, y"),
                                           S.values_cte("sr", "rule_id", [r.rule_id for r in td.RULES])) + """
SELECT sr.rule_id, CAST(count(hits.rule_id) AS BIGINT) AS n,
       CAST(coalesce(sum(CASE WHEN y = 0 THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_event
FROM sr LEFT JOIN hits ON hits.rule_id = sr.rule_id GROUP BY sr.rule_id""")
def q_streaming_rule_counts(spark, sf_dir):
    """Streaming J6 + per-rule counts: the case table is landed as Parquet
    files in the shared folder, read back with ``readStream`` in micro-batches
    of eight files, matched against the rules and counted with checkpointed
    state; the final counts equal the batch computation."""
    c = td.cases(spark, sf_dir)
    src = scratch_path(spark, "stream-source")
    c.write.mode("overwrite").parquet(src)
    return stream_ops.rule_counts_from_files(spark, src, c.schema, td.RULES, event_label=0, files_per_batch=8)


# ---------------------------------------------------------------------------
# Report sink, reshape round trip
# ---------------------------------------------------------------------------


@register("rule_facts_report", S.with_ctes(*_split_sql_ctes(), *_facts_sql()) + """
SELECT rule_id, n_train, round(empirical_risk, 3) AS empirical_risk FROM facts""", reuse_cases=_RULE_COLS)
def q_rule_facts_report(spark, sf_dir):
    """The rule facts rounded to 3 digits, written as a CSV report to the
    shared folder and read back with a fixed schema."""
    facts = training_facts(spark, sf_dir)
    path = scratch_path(spark, "rule-facts-report")
    rep.write_report(facts, path, digits=3, fmt="csv")
    return rep.read_report(spark, path, facts.schema, fmt="csv")


@register("rule_risk_reshaped", S.with_ctes(*_rule_risk_ctes(), f"\n_x AS ({_RULE_RISK_BODY})") + """
SELECT rule_id, dataset, n, actual_risk,
       CAST(CASE dataset WHEN 'train_pool' THEN 1 WHEN 'short_term' THEN 2 WHEN 'mid_term' THEN 3 END AS INTEGER)
         AS dataset_order
FROM _x""")
def q_rule_risk_reshaped(spark, sf_dir):
    """Pivot (fixed key list) of the rule risk table to one row per rule,
    then O6 (several measures per data set back to long) and O2 (order of a
    given list)."""
    rr = q_rule_risk(spark, sf_dir)
    wide = rr.groupBy("rule_id").pivot("dataset", S.DATASETS).agg(
        F.first("n").alias("n"), F.first("actual_risk").alias("actual"))
    times = {d: {"n": f"{d}_n", "actual_risk": f"{d}_actual"} for d in S.DATASETS}
    long = rs.multi_measure_long(wide, ["rule_id"], times, timevar="dataset")
    return long.withColumn("dataset_order",
                           rs.list_position("dataset", S.DATASETS).cast("int"))


# ---------------------------------------------------------------------------
# Distinct rows, class weights
# ---------------------------------------------------------------------------

@register("distinct_profiles", S.with_ctes(S.cases_cte()) + """
SELECT DISTINCT segment, status, region, priority FROM cases""")
def q_distinct_profiles(spark, sf_dir):
    """A5: distinct rows (``group_by_all() %>% summarize()``) of the case
    categories – partial aggregation, then one shuffle of distinct keys."""
    return td.cases(spark, sf_dir).select("segment", "status", "region", "priority").distinct()


@register("class_weights", S.with_ctes(*_split_sql_ctes()) + """,
  c AS (SELECT y, count(*) AS n_class FROM train GROUP BY y),
  t AS (SELECT sum(n_class) AS n, count(*) AS k FROM c)
SELECT c.y, CAST(c.n_class AS BIGINT) AS n_class, round(t.n * 1.0 / (t.k * c.n_class), 6) AS weight
FROM c CROSS JOIN t""", reuse_cases=_SPLIT_COLS)
def q_class_weights(spark, sf_dir):
    """Inverse class-frequency weights n / (k · n_class) of the training
    split (the weights of the balanced boosted-tree fit)."""
    w = st.class_weights(training_cases(spark, sf_dir).select("y"), "y", "weight")
    return (w.groupBy("y", "weight").agg(F.count(F.lit(1)).cast("bigint").alias("n_class"))
            .select("y", "n_class", _r("weight").alias("weight")))
