import math
from fractions import Fraction

import pytest

from ruleweave.llm import mixing as M


def _docs(spark, sizes):
    rows = [(i, s, "t", 1) for s, n in sizes.items() for i in range(sum(v for k, v in list(sizes.items())[:list(sizes).index(s)]), sum(v for k, v in list(sizes.items())[:list(sizes).index(s) + 1]))]
    return spark.createDataFrame(rows, "doc_id long, source string, text string, mix_slot int")


def test_every_block_keeps_its_window_and_the_deviation_is_under_one_block(spark):
    sizes = {"a": 900, "b": 200, "c": 57, None: 130, "d": 5}
    got = M.mix_sources(_docs(spark, sizes), block_rows=4, period=100).collect()
    assert len(got) == sum(sizes.values()) and len({r.doc_id for r in got}) == len(got)
    units = {r.source: r.mix_units for r in got}
    assert sum(units.values()) == 100 and min(units.values()) >= 1
    slots = {}
    for r in got:
        slots.setdefault(r.source, {}).setdefault(r.mix_slot, []).append(r.doc_id)
    taken = {}
    for s, by in slots.items():
        w = Fraction(units[s], 100)
        assert len(by) == math.ceil(sizes[s] / 4)
        for j, t in enumerate(sorted(by)):
            assert math.floor(j / w) <= t < math.ceil((j + 1) / w)
            assert len(by[t]) == 4 or j == len(by) - 1
            assert taken.setdefault(t, s) == s  # one block a slot
        for t in range(0, max(by) + 1):
            served = sum(x < t for x in by)
            assert abs(served - w * t) < 1
    ends = [r.mix_slot for r in got if r.in_mix]
    assert max(ends) < min(r.mix_slot for r in got if not r.in_mix)


def test_schedule_is_earliest_deadline_first(spark):
    units = {"a": 5, "b": 3, "c": 2}
    df = spark.createDataFrame([(s, 1, u) for s, u in units.items()], "source string, n long, units long")
    got = {r.slot: (r.source, r.unit) for r in M.period_schedule(df, 10).collect()}
    nxt = dict.fromkeys(units, 0)
    for t in range(10):
        ready = [(-(-(nxt[s] + 1) * 10 // u), s) for s, u in units.items() if nxt[s] < u and nxt[s] * 10 // u <= t]
        s = min(ready)[1]
        assert got[t] == (s, nxt[s])
        nxt[s] += 1


def test_given_weights_repeated_rows_and_empty_table(spark):
    df = _docs(spark, {"a": 40, "b": 40})
    w = spark.createDataFrame([("a", 30), ("b", 10)], "source string, units long")
    got = M.mix_sources(df, period=40, weights=w).collect()
    first = sorted(got, key=lambda r: r.mix_slot)[:40]
    assert sum(r.source == "a" for r in first) == 30
    twice = df.unionAll(df)
    assert M.mix_sources(twice).count() == 160
    assert M.mix_sources(twice).select("source", "mix_slot").distinct().count() == 160
    assert M.mix_sources(df.limit(0)).count() == 0


def test_too_many_sources_raise(spark):
    df = spark.createDataFrame([(i, f"s{i}") for i in range(11)], "doc_id long, source string")
    with pytest.raises(Exception, match="more than 10 sources"):
        M.mix_sources(df, period=10).collect()


def test_no_python_on_the_path(spark):
    plan = M.mix_sources(_docs(spark, {"a": 9, "b": 9}))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_deviation_over_the_whole_marked_ranges(spark):
    sizes = {"a": 900, "b": 200, "c": 58, None: 130, "d": 5}
    got = M.mix_sources(_docs(spark, sizes), block_rows=4, period=100).collect()
    units = {r.source: r.mix_units for r in got}
    rows = {s: sorted(r.mix_slot for r in got if r.source == s) for s in sizes}
    bound = max(r.mix_slot for r in got if r.on_target) + 1
    end = max(r.mix_slot for r in got if r.in_mix) + 1
    assert all(r.on_target == (r.mix_slot < bound) for r in got) and 0 < bound < end
    worst = 0
    for t in range(end + 1):
        gone = 0
        for s in sizes:
            target = Fraction(units[s] * t, 100)
            off = abs(len({x for x in rows[s] if x < t}) - target)  # in blocks
            worst = max(worst, off)
            if t <= bound:
                assert off < 1 and abs(sum(x < t for x in rows[s]) - 4 * target) < 4
            if off >= 1:  # only sources that have run out
                assert sum(x < t for x in rows[s]) == sizes[s]
                gone += units[s]
        assert gone <= 10
    assert worst > 1


def test_more_than_a_thousand_sources(spark):
    df = spark.range(1010).selectExpr("id AS doc_id", "concat('s', least(id, 1000)) AS source")
    got = M.mix_sources(df).collect()
    assert len(got) == 1010 and len({r.mix_slot for r in got}) == 1010
    units = {r.source: r.mix_units for r in got}
    assert len(units) == 1001 and sum(units.values()) == 2000 and min(units.values()) >= 1
    for s in ("s0", "s1000"):
        w = Fraction(units[s], 2000)
        for j, t in enumerate(sorted(r.mix_slot for r in got if r.source == s)):
            assert math.floor(j / w) <= t < math.ceil((j + 1) / w)
