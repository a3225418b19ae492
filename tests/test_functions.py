"""Functions on hand-made cases: expectations are written out, not computed."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessera.functions import documents, numbers, text, times
from tessera.operators import dictionary, dml, predicates, ranges, rules, sessions


def values(spark, cases, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_normalize(spark):
    assert values(spark, [" Ａ×B　(c)-d_e：f;，、\"“”' ", None, "■ x ✓", "﻿y"], text.normalize(F.col("t"))) == ["ａxbcdef", "", "x", "y"]


@pytest.mark.parametrize(("raw", "unit"), [("KG/每小时", "kg/h"), ("kg以下/每小时", "kg/h"), ("KW以内", "kw"), ("°", "℃"), ("转可调/每分钟", "转/分钟"), ("", "")])
def test_unit_key(spark, raw, unit):
    assert values(spark, [raw], text.unit_key(F.col("t"))) == [unit]


@pytest.mark.parametrize(("raw", "parsed"), [("1900MM", ("single", "1900", None, "MM", None)), ("3000-2000 kg/h", ("range", "3000", "2000", "kg/h", None)), ("x", ("none", None, None, None, None)), ("", ("none", None, None, None, None))])
def test_numbers_with_units(raw, parsed):
    assert numbers.parse_number(raw, ("kg/h", "kg", "mm")) == parsed


def test_values_are_read_as_they_were_put_together():
    """Random texts made of parts: what must be found is known from the parts."""
    rng = random.Random(1)
    number = lambda: str(rng.choice([rng.randint(0, 400), rng.randint(1, 99) / 10]))
    space = lambda: rng.choice(["", "", " ", "  "])
    for _ in range(800):
        v, f, phase = number(), number(), rng.choice("单三13")
        parts = [(0, v + space() + rng.choice("VvＶ伏")), (1, f + space() + rng.choice(["Hz", "hz", "HZ", "赫兹"])), (2, phase + space() + "相")]
        said = rng.sample(parts, rng.randint(0, 3))
        got = numbers.parse_voltage(rng.choice([" ", "，", "/"]).join(t for _, t in said))
        has = {k for k, t in said if "Ｖ" not in t}
        assert got == (f"{v}V" if 0 in has else None, f"{f}Hz" if 1 in has else None, numbers.PHASES[phase] if 2 in has else None), said
        a, b, unit, rest = number(), number(), rng.choice(["kg/h", "KG", "mm", "m³", ""]), rng.choice(["", "左右"])
        joint = rng.choice(["-", "~", "至", "－", "—"])
        several = rng.random() < 0.5
        text_ = space() + a + (space() + joint + space() + b if several else "") + space() + unit + (" " + rest if rest else "")
        kind, first, second, found, trailing = numbers.parse_number(text_, ("kg/h", "kg", "mm"))
        assert (kind, first, second) == (("range", a, b) if several else ("single", a, None)), text_
        assert (found or "") == (unit or rest) and (trailing or "") == (rest if unit else ""), text_
        sign, meaning = rng.choice([("≤", "<="), ("不小于", ">="), ("低于", "<"), (">", ">")])
        grade, ra, micro = rng.choice(["", "A级", "c级"]), rng.choice(["", "Ra"]), rng.choice(["", "um", "μm"])
        bound = numbers.parse_roughness(f"{grade} {sign}{space()}{ra}{space()}{a}{micro}")
        assert bound == (grade[:1].upper() or None, micro or None, None, None, meaning, float(a))
        span = numbers.parse_roughness(f"{grade} {ra}{a}{space()}-{space()}{b}{micro}")
        assert span == (grade[:1].upper() or None, micro or None, float(a), float(b), None, None)


def test_selections(spark):
    cases = [(f"{a}{m}{b}", m, a + b) for m in ("", "[SEL]", "【selected】", "[ S E L ]", "选中", "未选中") for a in ("", "未", "x ") for b in ("", " y")]
    def fate(mark, rest):
        if mark == "未选中" or mark and mark != "选中" and "未" in rest or mark == "选中" and rest.startswith("未"):
            return "unselected"
        return "selected" if mark else None
    assert values(spark, [c[0] for c in cases], numbers.selection(F.col("t"))) == [fate(m, r) for _, m, r in cases]


def test_chinese_integers():
    assert [numbers.chinese_integer(s) for s in ("一", "十", "十二", "二十", "九十九", "百", "x")] == [1, 10, 12, 20, 99, None, None]


@pytest.mark.parametrize(("raw", "parsed"), [("380V 50Hz 三相", ("380V", "50Hz", "三相")), ("220伏 1 相", ("220V", None, "单相")), ("60赫兹", (None, "60Hz", None)), ("none", (None, None, None)), (None, (None, None, None)), ("1.5 v", ("1.5V", None, None))])
def test_voltages(raw, parsed):
    assert numbers.parse_voltage(raw) == parsed


@pytest.mark.parametrize(
    ("raw", "parsed"),
    [
        ("Ra0.4-0.8um", (None, "um", 0.4, 0.8, None, None)), ("≤0.6 μm", (None, "μm", None, None, "<=", 0.6)), ("A级 Ra 1.6", ("A", None, None, None, None, 1.6)), ("不小于 2", (None, None, None, None, ">=", 2.0)),
        ("光滑", (None,) * 6), ("低于Ra 3", (None, None, None, None, "<", 3.0)), ("xB级", (None,) * 6), ("1至2", (None, None, 1.0, 2.0, None, None)), (None, (None,) * 6),
    ],
)
def test_roughness(raw, parsed):
    assert numbers.parse_roughness(raw) == parsed


@pytest.mark.parametrize(
    ("raw", "parsed"),
    [("温区12", ("温区", 12)), ("温区３", ("温区", 3)), ("模头二十一", ("模头", 21)), ("模头 十", ("模头", 10)), ("plain", (None, None)), ("zone012", ("zone0", 12)), ("zone10", ("zone", 10)), ("12", ("1", 2)), ("x0", (None, None)), ("一百", (None, None)), ("", (None, None)), (None, (None, None))],
)
def test_numbers_at_the_end_of_names(raw, parsed):
    assert numbers.parse_index(raw) == parsed


def test_leave_users_per_day(spark):
    rows = [("u1", "2026-06-15 08:00", "2026-06-16 18:00"), ("u1", "2026-06-16 09:00", "2026-06-16 17:00"), ("u2", "2026-06-16 09:00", "2026-06-16 17:00")]
    df = spark.createDataFrame(rows, "user string, a string, b string").select("user", F.to_timestamp("a").alias("a"), F.to_timestamp("b").alias("b"))
    got = ranges.days_of(df, "a", "b").groupBy("day").agg(F.count_distinct("user").alias("n")).collect()
    assert {str(r.day): r.n for r in got} == {"2026-06-15": 1, "2026-06-16": 2}


def test_half_points(spark):
    df = spark.sql("select date '2024-05-06' as d")
    got = df.select(*[times.half_point(F.col("d"), F.lit(p), b) for p in ("AM", "PM") for b in (True, False)]).first()
    assert list(got) == [datetime(2024, 5, 6), datetime(2024, 5, 6, 11, 59, 59), datetime(2024, 5, 6, 12), datetime(2024, 5, 6, 23, 59)]


def test_debounce_keeps_from_the_last_kept():
    fold, state, kept = sessions.debounce(15, True), None, []
    for t, k in ((0, "in"), (10, "in"), (16, "in"), (20, "out"), (29, "in"), (5, "in")):
        state, keep = fold(state, t * 1_000_000, k)
        kept.append(keep)
    assert kept == [True, False, True, True, False, True]


def test_empty_means_the_empty_text(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, "x")], "i int, t string")
    ids = lambda c: [r.i for r in df.where(predicates.condition(*c)).orderBy("i").collect()]
    assert ids(("t", "empty")) == [1] and ids(("t", "not_empty")) == [2, 3] and ids(("t", "ne", "x")) == [1, 2] and ids(("t", "nonsense")) == [1, 2, 3]


def test_upsert_with_null_keys(spark):
    t = spark.createDataFrame([(None, "a"), (1, "b")], "k int, v string")
    s = spark.createDataFrame([(None, "c"), (2, None)], "k int, v string")
    assert sorted(map(str, dml.upsert(t, s, ["k"]).collect())) == sorted(map(str, spark.createDataFrame([(None, "c"), (1, "b"), (2, None)], "k int, v string").collect()))


def test_patches():
    doc = {"a": [1, 2], "b": {"c": 1}}
    assert documents.apply_patch(doc, [{"op": "remove", "path": "/a/0"}, {"op": "add", "path": "/a/-", "value": 3}], ("/a",)) == {"a": [2, 3], "b": {"c": 1}}
    for bad in ("/b/c", "/a/9", "/ab"):
        with pytest.raises(ValueError):
            documents.apply_patch(doc, [{"op": "replace", "path": bad, "value": 0}], ("/a",))


def test_duplicate_reports(spark):
    rows = [(1, "f", "x", 3), (2, "f", "x", 0), (3, "f", "y", 0), (4, "g", None, 0), (5, "g", "z", 0), (6, "h", "q", 0)]
    got = dictionary.classify_duplicates(spark.createDataFrame(rows, "doc_id bigint, name string, content string, rank int")).collect()
    assert {(r.name, r.classification): r.canonical for r in got} == {("f", "different_content"): None, ("f", "same_content"): 2, ("g", "missing_blocks"): None}


def test_rules_stop_at_a_null_grade(spark):
    df = spark.createDataFrame([(5, 1.0, "x")], "q int, p double, c string")
    found = rules.apply_rules(df, [{"ruleType": "grade", "priority": 1}, {"ruleType": "grade", "priority": 2, "grade": "A"}, {"ruleType": "price", "priority": 2, "addition": 2}, {"ruleType": "price", "priority": 1, "step": {"interval": 2, "amount": 10}}], "p", "q").first()
    assert (found.p, found.grade, found.delivery_days) == (32.0, None, None)


def test_cycles_end(spark):
    df = spark.createDataFrame([(1, 2, "a"), (2, 1, "b"), (3, None, "c")], "id int, parent int, name string")
    assert {(r.id, r.cyclic, tuple(r.levels or ())) for r in dictionary.hierarchy(df).collect()} == {(1, True, ()), (2, True, ()), (3, False, ("c",))}


def test_tokens_are_the_normal_forms_of_their_parts(spark):
    """Also where lower case depends on what follows; no function is called for each part."""
    import re

    given = ["ΑΣ﻿Α Σ", " A×b , a×B(c)　ΟΔΟΣ/ΟΔΟΣ;", "", None, "；、|", "x\n-\nX y"]
    df = spark.createDataFrame([(t,) for t in given], "t string").select("t", text.tokens(F.col("t")).alias("v"))
    parts = lambda t: list(dict.fromkeys(x for x in map(text.normal_form, re.split(f"[,，、;；/|+{text.SPACES}]+", t)) if x))
    assert [r.v for r in df.collect()] == [None if t is None else parts(t) for t in given]
    assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()
