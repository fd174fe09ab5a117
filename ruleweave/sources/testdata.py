"""Stand-in inputs built from the driver's TPC-H-like tables.

These builders only produce rows in the schemas the analysis expects (a case
table, a rule list, survey answers, prediction scores).  They do none of the
analysis work; every operator downstream works on any data of that schema.

* ``cases``  – one row per order (role of the job-seeker case table).
* ``RULES``  – fixed structured rules over the case columns.
* ``survey`` – Likert answers per (expert, rule) derived from ``events``.
* ``scores`` – two closed-form risk scores per case (no trained model), so
               that SQL can check bins, calibration and AUC exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.levels import level_code
from ..functions.rules import Rule, rule
from ..operators.sampling import temporal_sets
from .tables import read

# ---------------------------------------------------------------------------
# Fixed values (must stay equal between the Spark queries and the SQL checks)
# ---------------------------------------------------------------------------
PRIORITY_LEVELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]

# Data-set windows (role of the train cut-off and the two future windows).
TRAIN_POOL_BEFORE = "1999-01-01"
FUTURE_START = "2000-01-01"
SHORT_TERM_END = "2000-06-30"

# Likert answer texts and their scores (the survey's fixed recode).
LIKERT_SCORES = {
    "Oluliselt väiksem": 1.0,
    "Väiksem": 0.75,
    "Sama": 0.5,
    "Suurem": 0.25,
    "Oluliselt suurem": 0.0,
    "Ei oska öelda": None,
}
DONT_KNOW = "Ei oska öelda"
N_EXPERTS = 7
N_RATED_RULES = 20

CASE_FEATURES = ["n_lines", "avg_qty", "max_discount", "ship_lag_days", "totalprice",
                 "acctbal", "priority_code", "segment", "status", "region"]
NUMERIC_FEATURES = ["n_lines", "avg_qty", "max_discount", "ship_lag_days", "totalprice",
                    "acctbal", "priority_code"]
NOMINAL_FEATURES = ["segment", "status", "region"]

# Fixed structured rules over the case table.  R15 matches no case, R16
# matches only orders without lines (one class), R3/R17 use a column with
# NULLs.  R21-R24 are not rated in the survey.
RULES: list[Rule] = [
    rule("R1", ("n_lines", ">", 4)),
    rule("R2", ("n_lines", "<=", 2), ("priority_code", "<=", 2)),
    rule("R3", ("segment", "in", ["BUILDING", "MACHINERY"]), ("max_discount", ">", 0.07)),
    rule("R4", ("n_lines", ">", 6), ("status", "==", "F")),
    rule("R5", ("avg_qty", ">", 30.0), ("n_lines", ">=", 3)),
    rule("R6", ("region", "in", ["ASIA", "EUROPE"]), ("n_lines", "<=", 3)),
    rule("R7", ("totalprice", ">", 300000.0)),
    rule("R8", ("acctbal", "<", 1000.0), ("n_lines", ">", 2)),
    rule("R9", ("priority_code", ">=", 4), ("n_lines", "<=", 1)),
    rule("R10", ("ship_lag_days", ">", 500.0)),
    rule("R11", ("status", "==", "O"), ("segment", "==", "AUTOMOBILE")),
    rule("R12", ("n_lines", ">", 3), ("max_discount", "<=", 0.05)),
    rule("R13", ("region", "==", "AFRICA"), ("totalprice", "<", 100000.0)),
    rule("R14", ("avg_qty", "<", 15.0)),
    rule("R15", ("n_lines", ">", 100)),
    rule("R16", ("n_lines", "<", 1)),
    rule("R17", ("max_discount", ">=", 0.09), ("priority_code", "==", 1)),
    rule("R18", ("segment", "not in", ["HOUSEHOLD"]), ("n_lines", ">", 5), ("acctbal", ">", 5000.0)),
    rule("R19", ("ship_lag_days", "<", -500.0), ("n_lines", ">=", 2)),
    rule("R20", ("priority_code", "in", [2, 3]), ("status", "!=", "P"), ("n_lines", ">", 4)),
    rule("R21", ("n_lines", ">=", 2), ("n_lines", "<=", 4)),
    rule("R22", ("totalprice", "<=", 50000.0)),
    rule("R23", ("region", "==", "AMERICA"), ("acctbal", ">", 8000.0)),
    rule("R24", ("max_discount", "==", 0.1)),
]


# S1 schema check: the columns (and types) the case build relies on.
_DATE_LIKE = (T.TimestampType(), T.TimestampNTZType(), T.DateType())
REQUIRED = {
    "lineitem": {"l_orderkey": T.LongType(), "l_returnflag": T.StringType(),
                 "l_quantity": T.DoubleType(), "l_discount": T.DoubleType(),
                 "l_shipdate": _DATE_LIKE},
    "orders": {"o_orderkey": T.LongType(), "o_custkey": T.LongType(),
               "o_orderstatus": T.StringType(), "o_totalprice": T.DoubleType(),
               "o_orderdate": _DATE_LIKE, "o_orderpriority": T.StringType()},
    "customer": {"c_custkey": T.LongType(), "c_nationkey": T.IntegerType(),
                 "c_acctbal": T.DoubleType(), "c_mktsegment": T.StringType()},
}


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: key, date, 0/1 target (0 = the risk event: some line
    was returned), line aggregates (NULL when an order has no lines) and
    order/customer attributes.

    Plan: lineitem is aggregated per order first (partial aggregation before
    the shuffle), then joined to orders on the same key (the aggregate output
    is already hash-partitioned on it).  nation and region have a fixed size
    (25 / 5 rows at every scale) and are broadcast; customer grows with the
    data and is joined by shuffle (AQE may turn it into a broadcast when its
    measured size is small).
    """
    li = read(spark, sf_dir, "lineitem", REQUIRED["lineitem"]).select(
        "l_orderkey", "l_returnflag", "l_quantity", "l_discount", "l_shipdate")
    lines = li.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines_raw"),
        F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("has_event"),
        F.avg("l_quantity").alias("avg_qty"),
        (F.max("l_discount") + F.lit(0.0)).alias("max_discount"),
        F.avg(F.unix_date(F.to_date("l_shipdate"))).alias("avg_ship_day"),
    )
    orders = read(spark, sf_dir, "orders", REQUIRED["orders"]).select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
        "o_orderpriority")
    cust = read(spark, sf_dir, "customer", REQUIRED["customer"]).select(
        "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    geo = (read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
           .join(F.broadcast(read(spark, sf_dir, "region").select("r_regionkey", "r_name")),
                 F.col("n_regionkey") == F.col("r_regionkey"))
           .select("n_nationkey", "r_name"))
    start = F.to_date("o_orderdate")
    df = (orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left")
          .join(cust, orders.o_custkey == cust.c_custkey, "inner")
          .join(F.broadcast(geo), F.col("c_nationkey") == F.col("n_nationkey"), "inner"))
    return df.select(
        F.col("o_orderkey").alias("case_id"),
        start.alias("start_date"),
        F.when(F.coalesce(F.col("has_event"), F.lit(0)) == 1, 0).otherwise(1).cast("int").alias("y"),
        F.coalesce(F.col("n_lines_raw"), F.lit(0)).cast("int").alias("n_lines"),
        F.col("avg_qty"),
        F.col("max_discount"),
        (F.col("avg_ship_day") - F.unix_date(start)).alias("ship_lag_days"),
        F.col("o_totalprice").alias("totalprice"),
        F.col("c_acctbal").alias("acctbal"),
        F.col("o_orderpriority").alias("priority"),
        level_code("o_orderpriority", PRIORITY_LEVELS).alias("priority_code"),
        F.col("c_mktsegment").alias("segment"),
        F.col("o_orderstatus").alias("status"),
        F.col("r_name").alias("region"),
    )


def survey_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survey answers, long form (expert_id, rule_id, answer text).

    Stand-in construction from ``events``: expert = user_id % 7, rated rule =
    R(event_id % 20 + 1), the mean event value of a cell is cut into the five
    Likert texts; some cells are "don't know".
    """
    ev = read(spark, sf_dir, "events").select("event_id", "user_id", "value")
    cells = (ev.groupBy((F.col("user_id") % N_EXPERTS).cast("int").alias("expert_id"),
                        (F.col("event_id") % N_RATED_RULES + 1).cast("int").alias("rule_no"))
             .agg(F.avg("value").alias("v")))
    text = (F.when(((F.col("expert_id") * 31 + F.col("rule_no")) % 11) == 0, F.lit(DONT_KNOW))
            .when(F.col("v") < 44.0, "Oluliselt suurem")
            .when(F.col("v") < 48.0, "Suurem")
            .when(F.col("v") < 52.0, "Sama")
            .when(F.col("v") < 56.0, "Väiksem")
            .otherwise("Oluliselt väiksem"))
    return cells.select("expert_id",
                        F.concat(F.lit("R"), F.col("rule_no").cast("string")).alias("rule_id"),
                        text.alias("answer_text"))


def survey_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same answers in the shape of the survey CSV: one row per expert,
    one text column per rated rule (R1..R20).  Pivot with a fixed value list
    (no distinct pass); the group count is the number of experts."""
    ids = [f"R{i}" for i in range(1, N_RATED_RULES + 1)]
    return (survey_long(spark, sf_dir).groupBy("expert_id").pivot("rule_id", ids)
            .agg(F.first("answer_text")))


# Closed-form scores: P(event) for two "models" (no training), rounded to 3
# digits so that ties occur.
SCORE_MODELS = {
    "m1": (-1.0, 0.5, 0.2),
    "m2": (0.5, 0.3, -0.25),
}


def score_expr(model: str) -> F.Column:
    b0, b_lines, b_prio = SCORE_MODELS[model]
    z = F.lit(b0) + F.lit(b_lines) * F.col("n_lines") + F.lit(b_prio) * F.col("priority_code")
    return F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-z)), 3)


def with_datasets(df: DataFrame) -> DataFrame:
    """The case table in its data sets (M4, ``operators.sampling.temporal_sets``)."""
    return temporal_sets(df, "start_date", TRAIN_POOL_BEFORE, FUTURE_START, SHORT_TERM_END)


def scores(spark: SparkSession, sf_dir: str, with_features: bool = False,
           case_table: DataFrame | None = None) -> DataFrame:
    """Long predictions (case_id, y, dataset, model, prob) for both closed-form
    models over all data sets; ``with_features`` keeps the case feature
    columns on each row (as a model's ``transform`` would)."""
    feats = CASE_FEATURES if with_features else ["n_lines", "priority_code"]
    base = case_table if case_table is not None else cases(spark, sf_dir)
    c = with_datasets(base.select("case_id", "y", "start_date", *feats))
    models = F.array(*[F.struct(F.lit(m).alias("model"), score_expr(m).alias("prob"))
                       for m in SCORE_MODELS])
    out = ["case_id", "y", "dataset"] + (CASE_FEATURES if with_features else [])
    return c.select(*out, F.inline(models))
