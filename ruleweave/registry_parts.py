"""Registered queries of single operators that the analysis queries of
``registry`` reach only inside model fits or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checks import sql as S
from .functions import levels as lv
from .functions.rules import rule
from .models import estimators as est
from .models.penalty_path import penalty_path
from .operators import reshape as rs
from .operators import sampling as smp
from .operators.coded_match import rule_id_counts
from .operators.match import match_rules, rule_score
from .operators.stats import minmax_scale, mode
from .plans import augmentation as aug
from .plans import disagreement as dis
from .registry import (_RULE_COLS, CONFOUNDER_DROP, _disagreement_sql_ctes, _r, _scores, _split_sql_ctes, disagreement_table,
                       register, training_cases)
from .sources import testdata as td
from .sources.tables import read

#: An ordered level list that lacks one of the stored values.
_SHORT_LEVELS = td.PRIORITY_LEVELS[:4]


@register("typed_orders", f"""
SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS customer,
       CASE WHEN o_orderpriority IN ({", ".join(f"'{v}'" for v in _SHORT_LEVELS)}) THEN o_orderpriority END AS o_orderpriority,
       CAST(CASE o_orderpriority {" ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(_SHORT_LEVELS, 1))} END AS DOUBLE) AS priority_code,
       TRY_CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS first_number,
       TRY_CAST(o_orderpriority AS DOUBLE) AS not_a_number,
       'O' || CAST(o_orderkey AS VARCHAR) AS order_id,
       o_orderstatus IN ('F', 'P') AS closed, NOT (o_orderstatus IN ('F', 'P')) AS open
FROM orders""")
def q_typed_orders(spark, sf_dir) -> DataFrame:
    """P1 (nominal cast), P2 (text outside the level list becomes NULL), P7
    (text to number, NULL where it is none), P10 (set membership), P15 (ids
    with a prefix)."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    o = o.withColumns({"first_number": lv.to_number(F.substring("o_orderpriority", 1, 1)),
                       "not_a_number": lv.to_number("o_orderpriority"),
                       "closed": lv.in_set("o_orderstatus", ["F", "P"]),
                       "open": lv.not_in_set("o_orderstatus", ["F", "P"]),
                       "order_id": lv.prefixed_id("o_orderkey", "O"),
                       "customer": F.col("o_custkey")})
    o = lv.with_ordered(lv.as_nominal(o, ["customer"]), "o_orderpriority", _SHORT_LEVELS, "priority_code")
    return o.select("o_orderkey", "customer", "o_orderpriority", F.col("priority_code").cast("double").alias("priority_code"),
                    "first_number", "not_a_number", "order_id", "closed", "open")


@register("tagged_balances", """
SELECT side, CAST(count(*) AS BIGINT) AS n, round(avg(balance), 6) AS mean FROM (
  SELECT 'customer' AS side, c_acctbal AS balance FROM customer
  UNION ALL SELECT 'supplier', s_acctbal FROM supplier) GROUP BY side""")
def q_tagged_balances(spark, sf_dir) -> DataFrame:
    """O4 + P14: union of two tables with a tag column, then a grouped mean."""
    parts = {"customer": read(spark, sf_dir, "customer").select(F.col("c_acctbal").alias("balance")),
             "supplier": read(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("balance"))}
    return rs.union_tagged(parts, "side").groupBy("side").agg(
        F.count(F.lit(1)).cast("bigint").alias("n"), _r(F.avg("balance")).alias("mean"))


_COLUMN_STATS = ["acctbal", "n_lines", "totalprice"]


@register("column_means", S.with_ctes(S.cases_cte()) + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, 'numeric' AS kind, round(avg(CAST({c} AS DOUBLE)), 6) AS mean FROM cases" for c in _COLUMN_STATS))
def q_column_means(spark, sf_dir) -> DataFrame:
    """O7 + P16 + P17: one row of means turned into (column name, value) rows,
    for the columns that the schema calls numeric."""
    c = td.cases(spark, sf_dir).select(*_COLUMN_STATS, "segment", "start_date")
    numeric = [x for x in c.columns if lv.column_kind(c, x) == "numeric"]
    one = c.agg(*[_r(F.avg(x)).alias(x) for x in numeric])
    return rs.wide_to_long(one, [], numeric, "feature", "mean").withColumn("kind", F.lit("numeric"))


@register("kept_cases", S.with_ctes(*_split_sql_ctes()) + """
SELECT case_id, y, segment FROM cases WHERE case_id IN (SELECT case_id FROM train)""")
def q_kept_cases(spark, sf_dir) -> DataFrame:
    """The cases of the training split (left semi join on the id)."""
    ids = training_cases(spark, sf_dir).select("case_id")
    return smp.keep_ids(td.cases(spark, sf_dir).select("case_id", "y", "segment"), ids, "case_id")


@register("bound_predictions", S.with_ctes(S.cases_cte(), S.datasets_cte(), S.scores_cte()) + """
SELECT c.case_id, p.dataset, p.model, p.prob, c.segment FROM cases c JOIN preds p ON p.case_id = c.case_id""")
def q_bound_predictions(spark, sf_dir) -> DataFrame:
    """Predictions bound to the rows they belong to, by key."""
    preds = _scores(spark, sf_dir).select("case_id", "dataset", "model", "prob")
    return td.cases(spark, sf_dir).select("case_id", "segment").join(preds, "case_id")


#: Fixed coefficients (multiples of 1/4, so that scores of exactly 0 occur).
_COEFFICIENTS = {r.rule_id: (i % 5 - 2) / 4 for i, r in enumerate(td.RULES)}


@register("fixed_rule_scores", S.with_ctes(S.cases_cte()) + f"""
SELECT case_id, round(1.0 / (1.0 + exp(-z)), 6) AS prob, CASE WHEN 1.0 / (1.0 + exp(-z)) >= 0.5 THEN 0 ELSE 1 END AS estimate
FROM (SELECT case_id, 0.25 + {" + ".join(f"CASE WHEN {r.to_sql()} THEN {_COEFFICIENTS[r.rule_id]!r} ELSE 0.0 END" for r in td.RULES)} AS z
      FROM cases)""")
def q_fixed_rule_scores(spark, sf_dir) -> DataFrame:
    """R8 with given coefficients, R9 (probability) and R10 (class; a
    probability of one half is the event)."""
    z = rule_score(td.RULES, _COEFFICIENTS, 0.25)
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
    scored = td.cases(spark, sf_dir).select("case_id", p.alias("p"))
    out = est.event_class(scored, "p")
    return out.select("case_id", _r("p").alias("prob"), F.col("estimate").cast("int"))


@register("model_rule_lists", S.with_ctes(*_disagreement_sql_ctes(), S.values_cte("allr", "rule_id", [r.rule_id for r in td.RULES])) + f"""
SELECT 'base' AS model, rule_id FROM allr
UNION ALL SELECT 'confounder', rule_id FROM allr WHERE rule_id NOT IN ({", ".join(f"'{r}'" for r in CONFOUNDER_DROP)})
UNION ALL SELECT 'k<=' || k.k, a.rule_id FROM allr a LEFT JOIN dj USING (rule_id) CROSS JOIN (SELECT range AS k FROM range(1, 5)) k
WHERE dj.penalty_rank IS NULL OR dj.penalty_rank <= k.k""", reuse_cases=_RULE_COLS)
def q_model_rule_lists(spark, sf_dir) -> DataFrame:
    """R12 + R13: the rules of every model – all, those kept up to each penalty
    rank, and all but the named ones."""
    ranks = disagreement_table(spark, sf_dir)
    subsets = aug.rule_subsets(td.RULES, ranks, ks=(1, 2, 3, 4), drop=CONFOUNDER_DROP)
    return spark.createDataFrame([(m, r.rule_id) for m, rules in subsets.items() for r in rules], "model string, rule_id string")


#: 150 rules made by a rule of their own: steps of price and lines.
MANY_RULES = [rule(f"S{i:03}", ("totalprice", ">", 2000.0 * i), ("n_lines", "<=", 1 + i % 7)) for i in range(150)]


@register("many_rules", S.with_ctes(S.cases_cte()) + """
SELECT 'S' || lpad(CAST(i AS VARCHAR), 3, '0') AS rule_id, CAST(count(case_id) AS BIGINT) AS n_train,
       round(avg(CASE WHEN y = 0 THEN 1.0 WHEN y IS NOT NULL THEN 0.0 END), 6) AS empirical_risk
FROM (SELECT range AS i FROM range(0, 150)) r
LEFT JOIN cases ON totalprice > 2000.0 * i AND n_lines <= 1 + i % 7 GROUP BY i""", reuse_cases=("y", "totalprice", "n_lines"))
def q_many_rules(spark, sf_dir) -> DataFrame:
    """R4 + R6 with more rules than one projection holds (150, two chunks)."""
    from .registry import _cases
    facts = dis.rule_facts(_cases(spark, sf_dir).select("y", "totalprice", "n_lines"), MANY_RULES, event_label=0)
    return facts.withColumn("empirical_risk", _r("empirical_risk"))


# 3,199 rules by parameter: rule i wants a price above one of 100 levels, at most
# one of 7 numbers of lines, a balance of at least one of 9 levels, and a segment
# other than one of 5.
N_THOUSANDS = 3199
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]  # fixed values
THOUSANDS = [rule(f"T{i:04}", ("totalprice", ">", 3000.0 * (i % 100)), ("n_lines", "<=", 1 + i % 7), ("acctbal", ">=", 1000.0 * (i % 9)),
                  ("segment", "!=", SEGMENTS[i % 5])) for i in range(N_THOUSANDS)]
#: Each 0.6 of the one before: the screening rule needs steps of less than a half.
PATH_PENALTIES = tuple(0.032 * 0.6 ** k for k in range(6))
_THOUSANDS_COLS = ("y", "totalprice", "n_lines", "acctbal", "segment")


@register("thousands_of_rules", S.with_ctes(S.cases_cte()) + f"""
SELECT 'T' || lpad(CAST(i AS VARCHAR), 4, '0') AS rule_id, CAST(count(y) AS BIGINT) AS n, CAST(count(*) FILTER (y = 0) AS BIGINT) AS n_event
FROM (SELECT range AS i FROM range(0, {N_THOUSANDS})) r
JOIN cases ON totalprice > 3000.0 * (i % 100) AND n_lines <= 1 + i % 7 AND acctbal >= 1000.0 * (i % 9)
  AND segment <> list_extract({SEGMENTS}, CAST(1 + i % 5 AS INTEGER)) GROUP BY i""", reuse_cases=_THOUSANDS_COLS)
def q_thousands_of_rules(spark, sf_dir) -> DataFrame:
    """R4 with 3,199 rules, matched by interval codes in one plan: cases and
    events of every rule with a case.  Cases are counted by their codes first, so
    the hits follow the codes and not the cases."""
    from .registry import _cases
    counted = rule_id_counts(_cases(spark, sf_dir).select(*_THOUSANDS_COLS), THOUSANDS, ["y"])
    hits = counted.select("y", "cases", F.explode("_ids").alias("rule_id"))
    events = F.when(F.col("y") == 0, F.col("cases")).otherwise(F.lit(0))
    return hits.groupBy("rule_id").agg(F.sum("cases").cast("bigint").alias("n"), F.sum(events).cast("bigint").alias("n_event"))


@register("rule_penalty_path", reuse_cases=True)
def q_rule_penalty_path(spark, sf_dir) -> DataFrame:
    """The lasso over 3,199 rules along a falling sequence of penalties –
    the rules left in the fit by screening, those taken in after the check of
    the optimality conditions, and those with a coefficient."""
    from .registry import training_cases
    matrix = est.counted_rule_matrix(training_cases(spark, sf_dir), THOUSANDS)
    steps = penalty_path(matrix, len(THOUSANDS), PATH_PENALTIES)
    return spark.createDataFrame([(s.reg_param, s.fitted, s.taken_in, s.kept) for s in steps],
                                 "reg_param double, n_fitted int, n_taken_in int, n_rules int")


@register("scaled_rule_hits", S.with_ctes(S.cases_cte(), S.hits_cte(td.RULES, "cases", "case_id")) + """,
  c AS (SELECT rule_id, CAST(count(*) AS BIGINT) AS n FROM hits GROUP BY rule_id)
SELECT rule_id, n, round((n - (SELECT min(n) FROM c)) * 1.0 / ((SELECT max(n) FROM c) - (SELECT min(n) FROM c)), 6) AS scaled FROM c""")
def q_scaled_rule_hits(spark, sf_dir) -> DataFrame:
    """J6 + A7: matched cases per rule, min–max scaled."""
    n = match_rules(td.cases(spark, sf_dir), td.RULES).groupBy("rule_id").agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    return minmax_scale(n, "n", out="scaled").withColumn("scaled", _r("scaled"))


@register("known_outcomes", S.with_ctes(S.cases_cte()) + """
SELECT dataset, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT 'train_pool' AS dataset FROM cases WHERE start_date + INTERVAL 180 DAY < DATE '1999-01-01'
  UNION ALL SELECT 'short_term' FROM cases WHERE start_date BETWEEN DATE '2000-01-01' AND DATE '2000-06-30'
  UNION ALL SELECT 'mid_term' FROM cases WHERE start_date >= DATE '2000-01-01') GROUP BY dataset""")
def q_known_outcomes(spark, sf_dir) -> DataFrame:
    """M4 with a horizon: a case trains only if its outcome, 180 days after its
    start, is known before the cut-off."""
    sets = smp.temporal_sets(td.cases(spark, sf_dir).select("start_date"), "start_date", td.TRAIN_POOL_BEFORE,
                             td.FUTURE_START, td.SHORT_TERM_END, horizon_days=180)
    return sets.groupBy("dataset").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


@register("status_modes", S.with_ctes(S.cases_cte()) + """,
  c AS (SELECT status, segment, count(*) AS n FROM cases GROUP BY ALL)
SELECT status, arg_max(segment, (n, segment)) AS mode FROM c GROUP BY status""")
def q_status_modes(spark, sf_dir) -> DataFrame:
    """A9 + O3: the most frequent segment per status (ties: last in text order)."""
    return mode(td.cases(spark, sf_dir).select("status", "segment"), ["status"], "segment")
