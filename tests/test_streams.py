"""Stays of a stream whose events come in any order, against a plain pass over them in order of time."""

import itertools
import random
from datetime import datetime, timedelta

import pytest

from tessera.streaming import twins

DAY0 = datetime(2024, 1, 1)
SCHEMA = "id long, user string, kind string, at timestamp"


def events(n=60):
    rng = random.Random(1)
    return [(i, rng.choice(["hot", "hot", "a", "b", None]), rng.choice(["in", "out", "out", "x"]), DAY0 + timedelta(milliseconds=rng.randint(0, 40) * 250, microseconds=rng.randint(0, 2))) for i in range(n)]


def plain(rows):
    out, open_ = [], {}
    for i, user, kind, at in sorted(set(rows), key=lambda r: (r[3], r[0])):
        if kind == "in":
            open_[user] = (i, at)
        elif kind == "out" and user in open_:
            out.append((user, *open_.pop(user), i, at))
    return sorted(out, key=str)


def run(spark, tmp_path, batches, **options):
    path = str(tmp_path / "in")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    end = [(10**6, "end", "x", DAY0 + timedelta(days=9))]
    feed = [lambda b=b: spark.createDataFrame(b, SCHEMA).write.mode("append").parquet(path) for b in [*batches, end]]
    return twins.run(twins.stays(twins.source(spark, path, spark.createDataFrame([], SCHEMA).schema), "user", "at", "kind", "id", "in", "out", "3 days", **options), feed)


@pytest.mark.parametrize("order", list(itertools.permutations(range(3)))[::2])
def test_stays_do_not_depend_on_the_order_of_arrival(spark, tmp_path, order):
    rows = events()
    parts = [rows[0::3], rows[1::3], rows[2::3] + rows[0:20]]  # some records come again
    got = run(spark, tmp_path, [parts[k] for k in order])
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)


def test_an_entry_that_nothing_ends_is_told_after_a_while(spark, tmp_path):
    at = lambda s: DAY0 + timedelta(seconds=s)
    rows = [(1, "u", "in", at(0)), (2, "u", "out", at(100)), (3, "u", "in", at(200)), (4, "u", "out", at(205)), (5, "v", "out", at(1))]
    got = run(spark, tmp_path, [rows[2:], rows[:2]], longest=60_000)
    assert sorted(map(tuple, got.collect())) == [("u", 1, at(0), None, None), ("u", 3, at(200), 4, at(205))]


class Held:
    """State of one key in memory, which counts what is asked of it."""

    def __init__(self):
        self.map, self.value, self.timers, self.calls = {}, None, set(), 0

    def getMapState(self, *_):
        return self

    def getValueState(self, *_):
        held = self

        class Value:
            exists = staticmethod(lambda: held.value is not None)
            get = staticmethod(lambda: held.value)
            update = staticmethod(lambda v: setattr(held, "value", v))
            clear = staticmethod(lambda: setattr(held, "value", None))

        return Value

    def _called(self, x=None):
        self.calls += 1
        return x

    def keys(self):
        return self._called(iter(list(self.map)))

    def containsKey(self, k):
        return self._called(k in self.map)

    def getValue(self, k):
        return self._called(self.map[k])

    def updateValue(self, k, v):
        self._called(self.map.__setitem__(k, v))

    def removeKey(self, k):
        self._called(self.map.pop(k))

    def registerTimer(self, t):
        self._called(self.timers.add(t))


@pytest.mark.parametrize("spread", [40, 400_000])
def test_stays_ask_their_state_for_pieces_and_not_for_each_event(spread):
    import pandas as pd

    rng, state = random.Random(2), Held()
    rows = [(rng.randint(0, spread) * 1000 + rng.randint(0, 2), i, rng.choice(["in", "out", "x"])) for i in range(900)]
    stays, got = twins.Stays("in", "out", None), []
    stays.init(state)
    for k, now in enumerate((0, spread // 2, spread + 2)):  # rows that the watermark has passed come no more; some come twice
        part = [r for i, r in enumerate(rows) if r[0] // 1000 >= (0, 0, spread // 2)[k] and (i % 3 <= k if k == 0 else True)]
        for at in range(0, len(part), 200):
            list(stays.handleInputRows(("u",), iter([pd.DataFrame(part[at : at + 200], columns=["micros", "record", "kind"])]), None))
        timer = type("T", (), {"getCurrentWatermarkInMs": lambda self, now=now: now, "getExpiryTimeInMs": lambda self: now})()
        while due := sorted(t for t in state.timers if t <= now):
            for told in stays.handleExpiredTimer(("u",), timer, timer):
                got += list(zip(told["entry"], told["exit"]))
            state.timers.discard(due[0])
    expected, entry = [], None
    for _, i, kind in sorted(rows):
        if kind == "in":
            entry = i
        elif kind == "out" and entry is not None:
            expected.append((entry, i))
            entry = None
    assert got == expected and not state.map
    assert state.calls < 300  # more than three for each event before


def test_stays_of_many_keys_ask_their_state_for_few_pieces():
    import pandas as pd

    rng, state = random.Random(3), Held()
    rows = [(rng.randint(0, 900_000) * 1000, i, rng.choice(["in", "out"]), f"={i % 300}") for i in range(1200)]
    stays, got = twins.Stays("in", "out", None), []
    stays.init(state)
    for k in range(3):
        list(stays.handleInputRows((7,), iter([pd.DataFrame(rows[k::3], columns=["micros", "record", "kind", "who"])]), None))
    for now in (450_000, 900_001):
        timer = type("T", (), {"getCurrentWatermarkInMs": lambda self, now=now: now})()
        while due := sorted(t for t in state.timers if t <= now):
            for told in stays.handleExpiredTimer((7,), timer, timer):
                got += list(zip(told["__who"], told["entry"], told["exit"]))
            state.timers.discard(due[0])
    expected, entries = [], {}
    for _, i, kind, who in sorted(rows):
        if kind == "in":
            entries[who] = i
        elif who in entries:
            expected.append((who, entries.pop(who), i))
    assert got == expected and not state.map
    assert state.calls < 100  # some for each of 300 keys before


def batches_of(spark, tmp_path, make, rows):
    """What a stream of three batches gives, and the most rows that its state had."""
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    stream = make(twins.source(spark, path, spark.createDataFrame([], SCHEMA).schema))
    writer, most = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True), 0
    for part in (*(rows[k::3] for k in range(3)), [(10**6, "end", "x", DAY0 + timedelta(days=9))]):
        spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(path)
        q = writer.start()
        q.awaitTermination()
        most = max(most, *(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress))
    return sorted((tuple(r) for r in spark.read.schema(stream.schema).parquet(out).collect()), key=str), most


def test_folds_keep_users_by_buckets(spark, tmp_path, monkeypatch):
    from tessera.operators import sessions

    monkeypatch.setattr(twins, "BUCKETS", 5)
    rows = [(i, None if i % 50 == 0 else f"u{i % 50}", "x", DAY0 + timedelta(seconds=i // 3)) for i in range(600)]
    rows = sorted(rows, key=lambda r: r[0] % 3)
    rows = [r for k in range(200) for r in (rows[k], rows[200 + k], rows[400 + k])]  # each batch holds a third of them, in order of time
    got, most = batches_of(spark, tmp_path, lambda s: twins.folded(s, "user", "at", "kind", ["id"], sessions.debounce(40, False), "keep").where("user is null or user <> 'end'"), rows)
    expected, last = [], {}
    for part in range(3):
        for i, user, kind, at in sorted(rows[part::3], key=lambda r: (r[3], r[0])):
            keep = user not in last or not timedelta() <= at - last[user] < timedelta(seconds=40)
            last |= {user: at} if keep else {}
            expected.append((i, user, kind, at, keep))
    assert got == sorted(expected, key=str) and most <= 5  # a row of state for each of 50 users before


def test_alarms_keep_users_by_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(twins, "BUCKETS", 5)
    at = lambda i: DAY0 + timedelta(minutes=i)
    rows = [(u, None if u == 0 else f"u{u}", "out", at(u % 7)) for u in range(60)] + [(100 + u, None if u == 0 else f"u{u}", "x" if u % 2 else "in", at(u % 7 + 12)) for u in range(60)]
    got, most = batches_of(spark, tmp_path, lambda s: twins.overdue(s, "user", "at", "kind", "out", "in", (10, 20), "1 day"), rows)
    expected = [(None if u == 0 else f"u{u}", at(u % 7), m) for u in range(60) for m in (10, 20) if m == 10 or u % 2]
    assert got == sorted(expected, key=str) and most <= 5  # a row of state for each of 60 users before
