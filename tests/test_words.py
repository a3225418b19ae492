"""Rules over word classes against brute force on random sequences, and residues by what they were made of."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import text, words
from tessera.operators import concepts, residues


def spelled(steps, most=3):
    """Every sequence of classes that some steps stand for, written out."""
    choices = []
    for step in steps:
        kinds = step.rstrip("?+").split("|")
        runs = [[()]] if step.endswith("?") else []
        runs += [list(itertools.product(kinds, repeat=n)) for n in range(1, most + 1 if step.endswith("+") else 2)]
        choices.append([r for run in runs for r in run])
    return {sum(c, ()) for c in itertools.product(*choices)}


@pytest.mark.parametrize("steps", [("a",), ("a", "b|c"), ("a?", "b", "c+"), ("a", "b+", "a|c"), ("a?", "b?", "c")])
def test_sequences_are_found_where_brute_force_finds_them(steps):
    rng = random.Random(str(steps))
    every = spelled(steps)
    for _ in range(300):
        kinds = tuple(rng.choice("abc") for _ in range(rng.randint(0, 6)))
        tokens = [words.Token(k, i, i + 1) for i, k in enumerate(kinds)]
        starts = [i for i in range(len(kinds)) if any(kinds[i : i + len(s)] == s for s in every)]
        found = words.find(tokens, steps)
        assert (found and found[0]) == (starts[0] if starts else None)


def test_scanning_covers_all_but_white_space():
    scan = words.lexicon({"unit": ("mm", "kg/h", "m"), "layer": ("层",), "wide": ("上限",)})
    rng = random.Random(5)
    pieces = ["mm", "MM", "kg/h", "m", "mx", "层", "上限", "上", "12", "1.5", "1.", "十二", "Ａ", " ", "　", "\n", "-", "İ", "x"]
    for _ in range(300):
        s = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 8)))
        tokens = scan(s)
        assert "".join(s[t.start : t.end] for t in tokens) == "".join(c for c in s if c not in text.SPACES)
        assert all(a.end <= b.start for a, b in itertools.pairwise(tokens))
    kinds = lambda s: [t.kind for t in scan(s)]
    assert kinds("12MM 1.5kg/h mmx 上限A层十一") == ["number", "unit", "number", "unit", "letters", "wide", "letters", "layer", "numeral"]


def test_qualified_and_numbered_by_brute_force():
    """Random sequences of marked words: the rules are held against a search over the sequence itself."""
    rng = random.Random(6)
    given = {"左侧": "side", "第": "ordinal", "3": "n", "十一": "n", "套": "set", "sheet": "sheet", "层": "layer", "B": "letter", "厚度": "gap", "#": "sign", "号": "place", "钢": "other", " ": None}
    for _ in range(3000):
        seq = [rng.choice(list(given)) for _ in range(rng.randint(0, 5))]
        seq = [w for w, before in zip(seq, [None, *seq]) if not (given[w] == "n" and before and given[before] == "n" or w in ("B", "sheet") and before in ("B", "sheet"))]
        k = [given[w] for w in seq if given[w]]
        has = lambda *p: any(tuple(k[i : i + len(p)]) == p for i in range(len(k)))
        counted = next((i + 2 for i in range(len(k)) if k[i] == "n" and k[i + 1 : i + 2] in (["set"], ["sheet"])), None)
        expected = has("side") or has("ordinal", "n", "set") or has("ordinal", "n", "layer") or has("letter", "layer") or (counted is not None and "gap" in k[counted:])
        assert concepts.is_qualified("".join(seq)) == expected, seq
        digits = any(seq[i] == "3" and [w for w in seq[i + 1 :] if w != " "][:1] == ["#"] for i in range(len(seq)))
        assert concepts.is_numbered("".join(seq)) == (has("ordinal", "n", "set") or has("n", "place") or digits), seq


@pytest.mark.parametrize(
    ("value", "source", "term_type", "joined"),
    [
        ("PE/PP", None, None, True), ("PE", "PE及PP", None, True), ("PE", None, None, False), ("100kg/h", None, None, True), ("kg / h", None, None, False), ("a_b", "x/y", None, False), ("12 mm", "a+b", None, False),
        ("12 mm、3 mm", None, None, True), ("推、拉", None, "lip_adjustment_method", False), ("推、拉", None, None, True), ("单腔流道／衣架式", None, "flow_channel_type", False), ("单腔流道/衣架式/x", None, "flow_channel_type", True), (None, "a/b", None, False), ("", "", "", False),
    ],
)
def test_composites(value, source, term_type, joined):
    assert concepts.is_composite(value, source, term_type) is joined


@pytest.mark.parametrize(
    ("value", "parts"),
    [
        ("A层 SJ-65 mm挤出机 产量 100 kg/h以上 原料：PE/PP", "型号=SJ-65 mm；产量=100 kg/h以上；原料=PE/PP"), ("第十一层 Φ45螺杆 3.5 公斤 / 小时", "型号=Φ45；产量=3.5 公斤 / 小时"), ("SJ65挤出机 100kg/h", None),
        ("C 层 材料 PP", None), ("a层 树脂 PE，PP 100千克/小时", "产量=100千克/小时；原料=PE，PP"), ("a层 原料PE粒 5kg/h", None), ("", None), (None, None),
    ],
)
def test_layers(value, parts):
    assert concepts.layer_of(value) == parts


def test_residues_are_what_they_were_made_of():
    """Pieces are put together of classes, so the fate is known from the parts alone."""
    rng = random.Random(7)
    for _ in range(2000):
        code, body, note = rng.choice(["PP", "ABS", "", "x1", "Q-9"]), rng.choice(["板材", "流延膜", "改性", "滑石粉", "生产线"]), rng.choice(["", "（兼顾x）", "温度", "，产量高", "、" + "工艺温度"])
        action, targets = residues.decide("plastic_material", code + body + note)
        listed, product = note[:1] in ("，", "、"), body in ("板材", "流延膜", "生产线")
        if not product:
            lost = body == "滑石粉" and (not note or listed) or note == "温度"
            assert (action, targets) == (("suppress" if lost else "candidate"), ()), (code, body, note)
        elif note in ("", "，产量高", "、工艺温度"):
            assert action == "reroute" and targets == ((("plastic_material", code), ("application", body)) if code else (("application", body),))
        elif body == "生产线" and not code:
            assert (action, targets) == (("suppress", ()) if note == "温度" else ("candidate", ()))  # nothing stands before the machine
        else:
            assert action == "reroute" and targets == (("application", body if code in ("PP", "ABS", "") else code + body),)


@pytest.mark.parametrize(
    ("value", "application"),
    [("（PE流延膜）", "流延膜"), ("含30%滑石粉板材", "板材"), ("原料：薄膜", "薄膜"), ("自动薄膜", "薄膜"), ("模头，适用于片材", "片材"), ("板材厚度2mm", "板材"), ("管材共3套", "管材"), ("管材 十二套（备用）", "管材"), ("客户提供膜", None), ("PP", None), ("", None)],
)
def test_what_surrounds_an_application_goes(value, application):
    assert residues.application_of(value) == application


def test_lists_of_materials_and_odd_values(spark):
    assert residues.decide("plastic_material", "PP板材、PE板材、PP片材") == ("reroute", (("plastic_material", "PP"), ("application", "板材"), ("plastic_material", "PE"), ("application", "片材")))
    assert residues.decide("plastic_material", "、，") == residues.decide(None, " ") == residues.decide("application", None) == ("suppress", ())
    assert residues.decide("application", "PE流延膜") == ("reroute", (("plastic_material", "PE"), ("application", "流延膜")))
    df = spark.createDataFrame([(None, None), ("plastic_material", "PP板材"), ("x", "膜" * 50_000)], "t string, v string")
    assert [(r[0], len(r[1])) for r in df.select(residues.fates(F.col("t"), F.col("v")).alias("f")).select("f.*").collect()] == [("suppress", 0), ("reroute", 2), ("candidate", 0)]


def test_normal_form_is_that_of_the_column(spark):
    rng = random.Random(8)
    given = ["".join(rng.choice("×■ 　 ()（）【-：;，\"ABÄΣσİx1\t\n﻿") for _ in range(rng.randint(0, 12))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, t string")
    got = [tuple(r) for r in df.orderBy("i").select(text.normalize(F.col("t")), text.no_space(F.col("t"))).collect()]
    assert [g[0] for g in got] == [text.normal_form(t) for t in given]
    assert [g[1] for g in got] == ["".join(c for c in t if c not in text.SPACES) for t in given]
