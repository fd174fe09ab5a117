"""SQL (DuckDB dialect) twins of the registered queries, used as the
correctness oracle.  They are written independently of the Spark plans –
plain CTEs, UNION ALL per rule, window functions – and share only the fixed
parameters (rules, cut-offs, level lists) with the Spark side.
"""

from __future__ import annotations

from ..functions.rules import Rule
from ..sources import testdata as td

DATASETS = ["train_pool", "short_term", "mid_term"]


def cases_cte() -> str:
    prio = " ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(td.PRIORITY_LEVELS, 1))
    return f"""
cases AS (
  SELECT o.o_orderkey AS case_id,
         CAST(o.o_orderdate AS DATE) AS start_date,
         CAST(CASE WHEN coalesce(li.has_event, 0) = 1 THEN 0 ELSE 1 END AS INTEGER) AS y,
         CAST(coalesce(li.n_lines_raw, 0) AS INTEGER) AS n_lines,
         li.avg_qty,
         li.max_discount,
         li.avg_ship_day - date_diff('day', DATE '1970-01-01', CAST(o.o_orderdate AS DATE)) AS ship_lag_days,
         o.o_totalprice AS totalprice,
         c.c_acctbal AS acctbal,
         o.o_orderpriority AS priority,
         CAST(CASE o.o_orderpriority {prio} END AS INTEGER) AS priority_code,
         c.c_mktsegment AS segment,
         o.o_orderstatus AS status,
         r.r_name AS region
  FROM orders o
  LEFT JOIN (
    SELECT l_orderkey,
           count(*) AS n_lines_raw,
           max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS has_event,
           avg(l_quantity) AS avg_qty,
           max(l_discount) + 0.0 AS max_discount,
           avg(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE))) AS avg_ship_day
    FROM lineitem GROUP BY l_orderkey) li ON li.l_orderkey = o.o_orderkey
  JOIN customer c ON c.c_custkey = o.o_custkey
  JOIN nation n ON n.n_nationkey = c.c_nationkey
  JOIN region r ON r.r_regionkey = n.n_regionkey
)"""


def datasets_cte(src: str = "cases", name: str = "ds") -> str:
    return f"""
{name} AS (
  SELECT *, 'train_pool' AS dataset FROM {src} WHERE start_date < DATE '{td.TRAIN_POOL_BEFORE}'
  UNION ALL
  SELECT *, 'short_term' AS dataset FROM {src}
   WHERE start_date >= DATE '{td.FUTURE_START}' AND start_date <= DATE '{td.SHORT_TERM_END}'
  UNION ALL
  SELECT *, 'mid_term' AS dataset FROM {src} WHERE start_date >= DATE '{td.FUTURE_START}'
)"""


def hits_cte(rules: list[Rule], src: str, cols: str, name: str = "hits") -> str:
    parts = [f"  SELECT {cols}, '{r.rule_id}' AS rule_id FROM {src} WHERE {r.to_sql()}"
             for r in rules]
    return f"\n{name} AS (\n" + "\n  UNION ALL\n".join(parts) + "\n)"


def values_cte(name: str, col: str, values: list[str]) -> str:
    vals = ", ".join(f"('{v}')" for v in values)
    return f"\n{name} AS (SELECT * FROM (VALUES {vals}) t({col}))"


def score_sql(model: str) -> str:
    b0, b_lines, b_prio = td.SCORE_MODELS[model]
    return (f"round(1.0 / (1.0 + exp(-({b0} + {b_lines} * n_lines + {b_prio} * priority_code))), 3)")


def scores_cte(name: str = "preds") -> str:
    parts = [f"  SELECT case_id, y, dataset, '{m}' AS model, {score_sql(m)} AS prob FROM ds"
             for m in td.SCORE_MODELS]
    return f"\n{name} AS (\n" + "\n  UNION ALL\n".join(parts) + "\n)"


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"


def auc_sql(src: str, group_cols: list[str], event_label: int = 0, direction: str = "higher_is_event",
            score: str = "prob", label: str = "y") -> str:
    """Exact tie-aware AUC per group, as SQL over ``src``."""
    g = ", ".join(group_cols)
    gsel = g + ", " if g else ""
    part = f"PARTITION BY {g} " if g else ""
    raw = "sum(pos * (neg_below + 0.5 * neg)) / (sum(pos) * sum(neg))"
    if direction == "higher_is_event":
        auc = raw
    elif direction == "lower_is_event":
        auc = f"1.0 - {raw}"
    else:
        auc = f"CASE WHEN any_value(med_neg) <= any_value(med_pos) THEN {raw} ELSE 1.0 - {raw} END"
    med = ""
    medjoin = ""
    if direction == "auto":
        med = f""",
  _med AS (SELECT {gsel}median({score}) FILTER (WHERE {label} = {event_label}) AS med_pos,
                 median({score}) FILTER (WHERE {label} <> {event_label}) AS med_neg
           FROM {src} WHERE {score} IS NOT NULL AND {label} IS NOT NULL GROUP BY ALL)"""
        medjoin = f" JOIN _med USING ({g})" if g else " CROSS JOIN _med"
    return f"""
  _cnt AS (SELECT {gsel}{score} AS score,
                  sum(CASE WHEN {label} = {event_label} THEN 1 ELSE 0 END) AS pos,
                  sum(CASE WHEN {label} <> {event_label} THEN 1 ELSE 0 END) AS neg
           FROM {src} WHERE {score} IS NOT NULL AND {label} IS NOT NULL GROUP BY ALL),
  _cum AS (SELECT *, coalesce(sum(neg) OVER ({part}ORDER BY score
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below FROM _cnt){med},
  _auc AS (SELECT {gsel}CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN {auc} END AS auc,
                  CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg
           FROM _cum{medjoin} GROUP BY ALL)"""


def fixed_bin_sql(x: str, breaks: list[float], labels: list[str] | None = None) -> str:
    parts = []
    for i in range(1, len(breaks)):
        val = f"'{labels[i - 1]}'" if labels else str(i)
        parts.append(f"WHEN {x} > {float(breaks[i - 1])!r} AND {x} <= {float(breaks[i])!r} THEN {val}")
    return "(CASE " + " ".join(parts) + " END)"


def count_above_sql(x: str, breaks_list: str, k: int) -> str:
    """1 + number of interior breaks (list elements 2..k) strictly below x."""
    terms = " + ".join(f"(CASE WHEN {breaks_list}[{i}] < {x} THEN 1 ELSE 0 END)" for i in range(2, k + 1))
    return f"(1 + {terms})"


def split_ctes(order_sql: str, prop: float = 0.2) -> list[str]:
    """pool (train-pool cases), sp (ranked), split (train/test), train."""
    return [f"""
pool AS (SELECT * FROM cases WHERE start_date < DATE '{td.TRAIN_POOL_BEFORE}')""", f"""
sp AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {order_sql}, case_id) AS rk,
              count(*) OVER (PARTITION BY y) AS n_stratum FROM pool)""", f"""
split AS (SELECT *, CASE WHEN rk <= floor({prop!r} * n_stratum) THEN 'train' ELSE 'test' END AS split FROM sp)""",
            """
train AS (SELECT * EXCLUDE (rk, n_stratum, split) FROM split WHERE split = 'train')"""]


def survey_ctes() -> list[str]:
    likert = " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in td.LIKERT_SCORES.items() if v is not None)
    return [f"""
ev AS (SELECT CAST(user_id % {td.N_EXPERTS} AS INTEGER) AS expert_id,
              CAST(event_id % {td.N_RATED_RULES} + 1 AS INTEGER) AS rule_no, avg(value) AS v
       FROM events GROUP BY ALL)""", f"""
sv AS (SELECT expert_id, 'R' || CAST(rule_no AS VARCHAR) AS rule_id,
              CASE WHEN (expert_id * 31 + rule_no) % 11 = 0 THEN '{td.DONT_KNOW}'
                   WHEN v < 44.0 THEN 'Oluliselt suurem' WHEN v < 48.0 THEN 'Suurem'
                   WHEN v < 52.0 THEN 'Sama' WHEN v < 56.0 THEN 'Väiksem'
                   ELSE 'Oluliselt väiksem' END AS answer_text FROM ev)""", f"""
ans AS (SELECT *, CAST(CASE answer_text {likert} ELSE NULL END AS DOUBLE) AS answer FROM sv)""", """
ex AS (SELECT rule_id, avg(answer) AS expert_assessment, stddev_samp(answer) AS ea_sd,
              CAST(count(answer) AS BIGINT) AS n_experts FROM ans GROUP BY rule_id)"""]


def rule_features_cte(rules: list[Rule], name: str = "rf") -> str:
    rows = ", ".join("('{}', [{}])".format(r.rule_id, ", ".join(f"'{f}'" for f in r.features))
                     for r in rules)
    return f"\n{name} AS (SELECT * FROM (VALUES {rows}) t(rule_id, features))"
