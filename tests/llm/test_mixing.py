"""Mixing: targets against a plain loop, and what a sample must keep to."""

import re

import pytest

from tessera.llm import mixing


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, full = {}, share * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in full]
        if not free:
            return target
        total = sum(w[s] for s in free)
        target |= {s: left * w[s] / total for s in free}
        over = [s for s in free if target[s] > most * sizes[s]]
        if not over:
            return target
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
            full.add(s)


@pytest.fixture(scope="module")
def mixed(spark):
    rows = [(i, " ".join(["w"] * (i * 7 % 53 + 1)), ["a", "b", None, "c", "d"][min(4, i % 9)], "x") for i in range(3000)]
    rows += [(3000, None, "a", "x"), (3001, "", "b", "x"), (5, rows[5][1], rows[5][2], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target string")
    return rows, mixing.mix(df).collect(), df


def test_targets_and_totals(mixed):
    rows, got, _ = mixed
    sizes = {}
    for _, text, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    expected = plain_targets(sizes)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(expected[r.source])
        assert 0 <= r.copies <= 2 and r.taken == r.copies * r.mix_size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert len(got) == len(rows)
    for s, t in taken.items():
        assert abs(t - expected[s]) <= 60, (s, t, expected[s])


def test_whole_copies_are_certain_and_reruns_agree(mixed):
    _, got, df = mixed
    for r in got:
        if r.mix_size:
            assert r.copies >= int(r.target // r.source_size)
    assert sorted(map(str, mixing.mix(df).collect())) == sorted(map(str, got))


def test_take_repeats_rows(spark, mixed):
    _, got, df = mixed
    assert mixing.take(mixing.mix(df), ["doc_id"]).count() == sum(r.copies for r in got)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(empty).count() == 0


def test_only_empty_texts(spark):
    df = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [(r.copies, r.target) for r in mixing.mix(df).collect()] == [(0, 0.0), (0, 0.0)]


@pytest.mark.parametrize("ids", [[7], [None], [1, 2, None]])
def test_repeated_ids_come_near_their_target(spark, ids):
    """Ties: rows that repeat an id draw a number each, so that a hot id neither overshoots nor stays out whole."""
    rows = [(ids[k % len(ids)], " ".join(["w"] * 8), "a") for k in range(400)] + [(1000 + k, " ".join(["w"] * (k % 9)), "b") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = mixing.mix(df).collect()
    assert len(got) == 700
    for source in "ab":
        mine = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 8
    counts = lambda rows: sorted((r.doc_id or -1, r.mix_size, r.taken) for r in rows)
    assert counts(got) == counts(mixing.mix(df.repartition(5)).collect())


def test_very_long_texts_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "w " * 300_000, "a", 5, 1), (2, "w", "b", 5, 1), (3, "w", "b", 5, 1)], "doc_id long, text string, source string, mix_place int, of_source int")
    got = {r.doc_id: r for r in mixing.mix(df).collect()}
    assert got[1].mix_size == 300_000 and got[1].taken <= 600_000 and len(got) == 3
