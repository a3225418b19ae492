"""Joins, repeats, searches, chats and the pipeline against brute force."""

import hashlib
import random
import re
import subprocess
import sys
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, chat, jaccard, repeats, shingles, topk, windows
from tessera.llm.common import ROOT, written
from tessera.llm.components import components


def near_copies(seed, n):
    """Texts with exact copies, near copies of all degrees, shared passages, short and empty ones."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(1, 4)))
    passage = [word() for _ in range(60)]
    out = [None, "", " \t", "one", "ONE", "one two", "One  two", "a b c", "a b c d"]
    while len(out) < n:
        base = [word() for _ in range(rng.choice((3, 8, 20, 60, 150)))]
        if rng.random() < 0.3:
            base += passage
        for _ in range(rng.choice((1, 1, 2, 6))):
            copy = list(base)
            for _ in range(rng.choice((0, 0, 1, 1, 2, 4))):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    return out[:n]


def brute_components(given, words, num, den):
    def shingle(t):
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        return frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()

    sets = [shingle(t) for t in given]
    comp = list(range(len(given)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(given)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                comp[b] = a
    return {i: (len(sets[i]), find(i)) for i in range(len(given))}


@pytest.mark.parametrize(("words", "num", "den"), [(3, 90, 100), (5, 80, 100)])
def test_join_is_exact(spark, words, num, den):
    given = near_copies(words, 220)
    df = spark.createDataFrame([(i, t, 9) for i, t in enumerate(given)], "doc_id long, text string, set_id int").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(df, words, num, den).collect()}
    assert got == brute_components(given, words, num, den)


def test_join_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.join(df).count() == 0
    two = spark.createDataFrame([(3, None), (3, None), (4, "x"), (4, "x")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(two).collect()) == [(3, 0, 3), (3, 0, 3), (4, 1, 4), (4, 1, 4)]


def null_and_repeated(seed, n=160):
    """(doc_id, text) with null ids for a third of the texts, repeated rows, and ids that several texts have."""
    given, rng = near_copies(seed, n), random.Random(seed)
    rows = [(None if rng.random() < 0.35 else i, t) for i, t in enumerate(given)]
    return rows + [rows[k] for k in range(0, n, 3) for _ in range(rng.choice((1, 1, 5)))] + [(rows[k][0], given[k + 1]) for k in range(0, n - 1, 11)]


def test_batches_of_empty_texts_in_fresh_workers(spark):
    """A worker whose first batch holds no word at all."""
    code = "from tessera.llm import shingles; import pyarrow as pa; print([len(s) for s in shingles.sets(pa.array([None, '', ' ']), 3)])"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.stdout.strip() == "[0, 0, 0]", out.stderr
    df = spark.createDataFrame([(1, ""), (2, None), (3, "a b c d"), (4, " ")], "doc_id long, text string").repartitionByRange(4, "doc_id")
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(df, 3, 90, 100).collect()} == {(1, 0, 1), (2, 0, 2), (3, 2, 3), (4, 0, 4)}


def test_join_links_null_ids_by_their_texts(spark):
    rows = null_and_repeated(5)
    groups = brute_components([t for _, t in rows], 5, 80, 100)
    least = {}
    for i, (_, c) in groups.items():
        if rows[i][0] is not None:
            least[c] = min(least.get(c, rows[i][0]), rows[i][0])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(df, 5, 80, 100).collect())
    assert got == Counter((rows[i][0], size, least.get(c)) for i, (size, c) in groups.items())


def test_one_row_of_each_group_survives(spark):
    import corpus_pipeline as p

    rows = null_and_repeated(6)
    groups = brute_components([t for _, t in rows], 5, 80, 100)
    members, texts = {}, {}
    for i, (_, c) in groups.items():
        members.setdefault(c, []).append(rows[i][0])
        texts.setdefault(rows[i][1], c)
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    after = p.drop_near_duplicates(spark, df, "").collect()
    assert tuple(after[0].asDict()) == p.COLUMNS
    full = [r for r in after if (r.text or "").strip()]
    assert Counter(texts[r.text] for r in full) == Counter({texts[t] for _, t in rows if (t or "").strip()})
    for r in full:
        ids = members[texts[r.text]]
        assert r.doc_id == min((i for i in ids if i is not None), default=None) and (r.doc_id, r.text) in rows
    assert Counter((r.doc_id, r.text) for r in after if not (r.text or "").strip()) == Counter(x for x in rows if not (x[1] or "").strip())


def test_all_rows_without_words_survive(spark):
    df = spark.createDataFrame([(1, ""), (1, ""), (1, None), (2, " "), (3, "a b c d e f"), (3, "a b c d e f")], "doc_id long, text string").repartition(3)
    assert sorted((r.doc_id, (r.text or "").strip()) for r in jaccard.survivors(df).collect()) == [(1, ""), (1, ""), (1, ""), (2, ""), (3, "a b c d e f")]


def test_null_id_links_two_texts(spark):
    """A chain that passes through a text without id holds together."""
    words = [f"w{i}" for i in range(100)]
    a, b, c = words, [*words[:95], *(f"x{i}" for i in range(5))], [*(f"y{i}" for i in range(5)), *words[5:95], *(f"x{i}" for i in range(5))]
    df = spark.createDataFrame([(1, " ".join(a)), (None, " ".join(b)), (2, " ".join(c))], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.component_id) for r in jaccard.join(df, 3, 85, 100).collect()) == [("1", 1), ("2", 1), ("None", 1)]


@pytest.mark.parametrize(("num", "den"), [(90, 100), (80, 100)])
def test_similar_sets_share_a_signature(num, den):
    rng = np.random.default_rng(1)
    enum = jaccard.PartEnum(num, den, 2 if num == 90 else 3, 1)
    for size in [*range(1, 60), 100, 333, 1000]:
        for _ in range(4):
            a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
            most = int((den - num) * len(a) / den)
            b = np.unique(np.concatenate((a[rng.permutation(len(a))[: len(a) - rng.integers(0, most + 1)]], rng.integers(0, 1 << 63, int(rng.integers(0, most + 1)), dtype=np.uint64))))
            inter = len(np.intersect1d(a, b))
            if den * inter >= num * (len(a) + len(b) - inter):
                assert np.intersect1d(enum.signatures(a), enum.signatures(b)).size


def test_sketches_rule_out_no_link():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    sets = [np.unique(np.where(rng.random(400) < p, rng.integers(0, 1 << 63, 400, dtype=np.uint64), base)) for p in rng.choice([0, 0.02, 0.05, 0.1, 0.3], 60)]
    n, label = np.array([len(s) for s in sets]), np.arange(60)
    side = np.where(np.arange(60) < 20, 0, 1)
    for sides in (np.full(60, 2), side):
        i, j = jaccard.may_link(n, label, np.stack([jaccard.sketch(s) for s in sets]), sides, 90, 100)
        out = {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist())}
        for a in range(60):
            for b in range(a + 1, 60):
                inter = len(np.intersect1d(sets[a], sets[b]))
                if 100 * inter >= 90 * (n[a] + n[b] - inter) and (sides[a] == 2 or sides[a] != sides[b]):
                    assert (a, b) in out
        assert len(out) < 60 * 59 / 3
        x, y = jaccard.nearest_links(n, label, np.stack([jaccard.sketch(s) for s in sets]), sides, 90, 100)
        near = {tuple(sorted(p)) for p in zip(x.tolist(), y.tolist())}
        ends = {v for p in out for v in p}
        gap = lambda p: np.bitwise_count(jaccard.sketch(sets[p[0]]) ^ jaccard.sketch(sets[p[1]])).sum() / (n[p[0]] + n[p[1]]) if len(jaccard.sketch(sets[p[0]])) == len(jaccard.sketch(sets[p[1]])) else None
        assert near <= out and len(near) <= 60 and {v for p in near for v in p} == ends
        for v in ends:
            assert min(gap(p) for p in near if v in p) == min(gap(p) for p in out if v in p)


def test_bounded_pieces_find_every_shared_signature():
    rng = np.random.default_rng(2)
    rows = np.stack((rng.integers(0, 40, 500), rng.integers(0, 30, 500)), axis=1).astype(np.uint64)
    carried, found = np.zeros((0, 2), np.uint64), set()
    for k in range(0, 500, 37):
        got, carried = jaccard._met([rows[k : k + 37].tobytes()], carried)
        found |= {(int(s), int(x)) for s, x in got}
    by = {}
    for s, x in rows.tolist():
        by.setdefault(s, set()).add(x)
    assert found == {(s, x) for s, xs in by.items() if len(xs) > 1 for x in xs}


def test_shingles_in_slices(monkeypatch):
    import pyarrow as pa

    given = pa.array(near_copies(7, 80))
    whole = [s.tolist() for s in shingles.sets(given, 3)]
    monkeypatch.setattr(shingles, "SLICE", 40)
    assert [s.tolist() for s in shingles.sets(given, 3)] == whole


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(400 + i, 401 + i) for i in range(60)]
    comp = {x: x for e in edges for x in e}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        comp[b] = a
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_repeats(given, length):
    data = [(t or "").encode() for t in given]
    counts = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        hit = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if counts[b[i : i + length]] > 1:
                hit[i : i + length] = b"\1" * length
        kept = bytes(x for x, h in zip(b, hit) if not h)
        out.append((len(b), sum(hit), sum(h and not (i and hit[i - 1]) for i, h in enumerate(hit)), hashlib.sha256(kept).hexdigest()))
    return out


def repeated_texts(seed=4):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(10, 900))) for _ in range(30)]
    out = [None, "", "x" * 199, "y" * 200, "z" * 201, "ab" * 300, "q" * 1000]
    for _ in range(90):
        s = ""
        for _ in range(rng.randint(1, 4)):
            p = rng.choice(base)
            a = rng.randint(0, len(p))
            s += p[a : rng.randint(a, len(p))] if rng.random() < 0.7 else p
            s += "".join(rng.choice("abcdé ") for _ in range(rng.choice((0, 0, 1, 30))))
        out.append(s)
    return [*out, *out[20:30]]


def test_repeats(spark):
    given = repeated_texts()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(given)], "doc_id long, text string, k string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove(df, digest=True).collect()}
    assert [got[i] for i in range(len(given))] == brute_repeats(given, 200)
    assert repeats.remove(df.where("false")).count() == 0


def test_rows_with_one_id_repeat_each_other(spark):
    text = "".join(random.Random(1).choice("abcdefgh") for _ in range(250))
    df = spark.createDataFrame([(1, text), (1, text), (2, text[:-60])], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in repeats.remove(df).collect()) == [(1, 250), (1, 250), (2, 0)]


def test_blocks_and_pieces_are_bounded(monkeypatch):
    """Small slices and sorts find the same repeats."""
    given = [t or "" for t in repeated_texts(5)]
    monkeypatch.setattr(repeats, "SLICE", 256)
    data = np.frombuffer("".join(given).encode(), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t.encode()) for t in given])))
    rows = [np.stack((b, w, t.astype(np.uint64), (s << 8 | (n - 1)).astype(np.uint64)), axis=1) for b, w, t, s, n in repeats.blocks(data, offsets, 32, 200)]
    rows = np.concatenate(rows)
    same, opened, carried = set(), set(), np.zeros((0, 4), np.uint64)
    for k in range(0, len(rows), 91):
        a, b, carried = repeats._refined(np.concatenate((carried, rows[k : k + 91])))
        same |= {tuple(r) for r in a.tolist()}
        opened |= {tuple(r) for r in b.tolist()}
    counts = Counter((r[0], r[1]) for r in map(tuple, rows.tolist()))
    kinds = {}
    for b, w in counts:
        kinds.setdefault(b, set()).add(w)
    assert same == {r for r in map(tuple, rows.tolist()) if counts[r[0], r[1]] > 1}
    assert {(r[0], r[1]) for r in opened} == {(b, w) for b, ws in kinds.items() if len(ws) > 1 for w in ws}


def test_identifiers_and_anchors():
    data = np.frombuffer(bytes(random.Random(2).choice(b"ab") for _ in range(3000)), np.uint8)
    raw = data.tobytes()
    grams, strings = windows.identifiers(data, 8, 21)
    for ids, n in ((grams, 8), (strings, 21)):
        seen = {}
        for i in range(len(raw) - n + 1):
            assert seen.setdefault(raw[i : i + n], ids[i]) == ids[i]
        assert len(set(seen.values())) == len(seen)
    at, place = windows.anchors(grams, 14), {}
    for i in range(len(raw) - 20):
        assert 0 <= at[i] - i < 14 and place.setdefault(raw[i : i + 21], at[i] - i) == at[i] - i


def vectors(spark, n=600, d=16, seed=1):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, d))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[50:90] = v[50]
    rows = [(i, [float(np.float32(x)) for x in v[i]]) for i in range(n)]
    odd = [(n, None), (n + 1, [0.0] * d), (n + 2, [float("nan")] * d), (n + 3, [None, *[1.0] * (d - 1)]), (n + 4, []), (n + 5, [float("inf")] * d)]
    return rows, spark.createDataFrame([(*r, 1) for r in rows + odd], "vec_id long, embedding array<float>, score int")


def test_exact_search(spark, monkeypatch):
    rows, df = vectors(spark)
    q = np.floor(1024 * np.array([r[1] for r in rows])).astype(np.int64)
    zero = len(rows) + 1  # a zero vector takes part in the integer search
    ids, q = np.array([*range(len(rows)), zero]), np.vstack((q, np.zeros((1, q.shape[1]), np.int64)))
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 128)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    got = {}
    for r in topk.search(df, F.col("vec_id") % 10 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for k, i in enumerate(ids):
        if i % 10 == 0:
            s = q @ q[k]
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:10]
            assert sorted(got[i]) == [(n + 1, ids[j], s[j]) for n, j in enumerate(order)]
    assert topk.search(df.where("vec_id = 10"), F.lit(True)).count() == 0


def test_pivots_eliminate():
    rng = np.random.default_rng(3)
    x = np.floor(rng.standard_normal((4000, 4)) * 100)
    p = topk.farthest_first(x[:500], 16)
    assert len(np.unique(p, axis=0)) == 16
    table = topk.distances(x, p)
    found = topk.search_block(x[:5], np.arange(5), table[:5], x, np.arange(4000), table, 10)
    for i, (_, ids, scores, seen) in enumerate(found):
        s = x @ x[i]
        s[i] = -np.inf
        order = np.lexsort((np.arange(4000), -s))[:10]
        assert (ids == order).all() and (scores == s[order]).all() and seen < 4000


def test_pivots_eliminate_most_of_clustered_vectors(spark):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((40, 32))
    v = centres[rng.integers(0, 40, 3000)] + 0.05 * rng.standard_normal((3000, 32))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v[i].tolist()) for i in range(3000)], "vec_id long, embedding array<double>").repartition(3)
    seen, held = topk.evaluated(df, F.col("vec_id") % 100 == 0).first()
    assert held == 30 * 3000 and seen < 0.2 * held
    q = np.floor(1024 * v).astype(np.int64)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.search(df, F.col("vec_id") % 100 == 0).collect()}
    for i in range(0, 3000, 100):
        s = q @ q[i]
        order = [j for j in np.lexsort((np.arange(3000), -s)) if j != i][:10]
        assert [got[i, n + 1] for n in range(10)] == [(j, s[j]) for j in order]


def test_rows_that_share_an_id_are_candidates_each(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.0]), (1, [0.5, 0.0]), (1, [0.25, 0.5]), (2, [1.0])], "vec_id long, embedding array<double>")
    got = [(r.rank, r.vec_id, r.score) for r in topk.search(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(1, 1, 512 * 1024), (2, 1, 512 * 1024), (3, 1, 256 * 1024)]


def test_only_the_querys_own_row_is_left_out(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.5, 0.0]), (0, [1.0, 0.0]), (1, [0.25, 0.0])], "vec_id long, embedding array<double>").repartition(3)
    got = [(r.rank, r.vec_id, r.score) for r in topk.search(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(1, 0, 512 * 1024), (2, 0, 512 * 1024), (3, 1, 512 * 256)]  # [0.5, 0.0] asks, as the smallest vector of its id


def test_approximate_search(spark):
    rows, df = vectors(spark, 1500)
    v = np.array([r[1] for r in rows])
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0, k=20).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = (r.rank, r.score)
    hits = total = 0
    for i in range(0, len(rows), 20):
        s = v @ v[i]
        s[i] = -9
        best = np.lexsort((np.arange(len(s)), -s))[:20]
        hits += len(set(best) & set(got[i]))
        total += 20
        assert all(abs(score - s[j]) < 1e-9 for j, (_, score) in got[i].items()) and i not in got[i]
    assert hits / total >= 0.9
    assert ann.search(df.where("false"), F.lit(True)).count() == 0


def test_recall_does_not_fall_with_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "CHUNK", 16)
    monkeypatch.setattr(ann, "QUERY_CHUNK", 20)
    rows, df = vectors(spark, 1500)
    v = np.array([r[1] for r in rows])
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0, k=20).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for i in range(0, len(rows), 20):
        s = v @ v[i]
        s[i] = -9
        hits += len(set(np.lexsort((np.arange(len(s)), -s))[:20]) & got.get(i, set()))
    assert hits / (75 * 20) >= 0.9


def test_only_what_the_tables_collect_is_multiplied():
    rng = np.random.default_rng(4)
    x, q = rng.standard_normal((90, 8)), rng.standard_normal((37, 8))
    keys, probed = (np.concatenate([ann.buckets(m, t, p) for t in range(4)], axis=1) for m, p in ((x, 1), (q, 3)))
    seen = np.array([[any(keys[j, t] in probed[i, 3 * t : 3 * t + 3] for t in range(4)) for j in range(90)] for i in range(37)])
    x_ids = np.arange(90)
    x[5], x_ids[5] = q[2], 102  # a query's own row
    for i, (_, ids, scores, products) in enumerate(ann.rerank(q, np.arange(100, 137), probed, x, x_ids, keys, 5)):
        best = [j for j in np.lexsort((x_ids, -(x @ q[i]))) if seen[i, j] and x_ids[j] != 100 + i][:5]
        assert ids.tolist() == x_ids[best].tolist() and np.allclose(scores, x[best] @ q[i]) and products == seen[i].sum()
    assert ann.rerank(q, np.arange(100, 137), probed, x[:0], x_ids[:0], keys[:0], 5)[0][3] == 0


def test_tables_leave_most_of_clustered_vectors_out(spark):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((60, 64))
    v = centres[rng.integers(0, 60, 3000)] + 0.2 * rng.standard_normal((3000, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v[i].tolist()) for i in range(3000)], "vec_id long, embedding array<double>").repartition(3)
    few = {"tables": 8, "probes": 1}
    products, held = ann.evaluated(df, F.col("vec_id") % 20 == 0, **few).first()
    assert held == 150 * 3000 and products < 0.15 * held
    got = {(r.query_id, r.vec_id) for r in ann.search(df, F.col("vec_id") % 20 == 0, **few).collect()}
    hits = 0
    for i in range(0, 3000, 20):
        s = v @ v[i]
        s[i] = -9
        hits += sum((i, j) in got for j in np.lexsort((np.arange(3000), -s))[:20].tolist())
    assert hits / (150 * 20) >= 0.9


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_the_given_vectors(spark, sf):
    """All queries against brute force, and the share of pairs that were multiplied."""
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.orderBy("vec_id").collect() if r.embedding]
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    got = {(r.query_id, r.vec_id) for r in ann.search(df, F.col("vec_id") % 20 == 0).collect()}
    hits = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = v @ v[i]
        s[i] = -9
        best = ids[np.lexsort((ids, -s))[:20]].tolist()
        hits, total = hits + sum((int(ids[i]), j) in got for j in best), total + len(best)
    products, held = ann.evaluated(df, F.col("vec_id") % 20 == 0).first()
    assert hits / total >= 0.93 and products < 0.56 * held


def test_rows_of_one_id_are_found_each(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.9, 0.1]), (1, [0.8, 0.0]), (1, [0.8, 0.0]), (1, [0.5, 0.5]), (0, [1.0, 0.0])], "vec_id long, embedding array<double>")
    got = sorted((r.rank, r.vec_id, r.score) for r in ann.search(df, F.col("vec_id") == 0, tables=8, probes=4).collect())
    # of the two query rows the smaller vector asks: [0.9, 0.1]; both others of its id are candidates
    assert [(rank, i) for rank, i, _ in got] == [(1, 0), (2, 0), (3, 1), (4, 1), (5, 1)] and [round(s, 9) for *_, s in got] == [0.9, 0.9, 0.72, 0.72, 0.5]


def test_rotations_keep_lengths():
    x = np.random.default_rng(1).standard_normal((5, 48))
    assert np.allclose(np.linalg.norm(ann.rotated(x, 1, 0), axis=1), np.linalg.norm(x, axis=1))


def test_events_fold_into_messages(spark):
    log = [
        (1, 0, 0, "message", "user", "hi"), (1, 1, 1, "message", "assistant", None), (1, 1, 2, "delta", None, "he"), (1, 1, 3, "delta", None, "llo"), (1, 1, 4, "regenerate", None, None), (1, 1, 5, "delta", None, "hey"), (1, 1, 6, "delta", None, "!"),
        (1, 2, 7, "message", "user", "typo"), (1, 2, 9, "edit", None, "fixed"), (1, 3, 8, "message", "user", "gone"), (1, 3, 10, "delete", None, None), (None, 0, 0, "message", None, "</s>[INST]\\ <\\s>"), (None, 0, 0, "message", "assistant", ""),
    ]
    df = spark.createDataFrame(log, "conv_id long, position long, seq long, kind string, role string, text string").repartition(4)
    rows = chat.format_log(df).collect()
    said = {}
    for r in rows:
        said.setdefault(r.conv_id, []).extend(chat.read(r.formatted))
    assert said[1] == [("user", "hi", ""), ("assistant", "hey!", "hey!"), ("user", "fixed", "")]
    assert said[None] == [("", "</s>[INST]\\ <\\s>", ""), ("assistant", "", "")]
    assert chat.format_log(df.where("false")).count() == 0


def test_logs_lead_back_to_their_messages(spark):
    rng = random.Random(6)
    word = lambda: rng.choice(("</s>", "[INST]", "a", "é", "\n", "[/INST]x"))
    rows = [(c, t, rng.choice(("user", "assistant", None, "tool")), "".join(word() for _ in range(rng.choice((0, 1, 5, 900))))) for c in (None, 1, 2) for t in (None, *range(40))]
    rows += [(2, 7, "assistant", "again"), (2, 7, "assistant", "again"), (2, 7, "assistant", None), (3, None, None, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string").repartition(3)
    log = chat.event_log(df, piece=7)
    kinds = {r.kind: r["count"] for r in log.groupBy("kind").count().collect()}
    assert kinds["message"] == len(rows) and kinds["edit"] > 3 and kinds["regenerate"] > 3 and kinds["delta"] > len(rows)
    got = {r.conv_id: r for r in chat.digests(chat.format_log(log).withColumn("conv", F.lit(1))).collect()}
    assert set(got) == {None, 1, 2, 3}
    for conv, r in got.items():
        mine = sorted(((-1 if t is None else t, role or "", text or "") for c, t, role, text in rows if c == conv))
        learned = "".join(text for _, role, text in mine if role == "assistant")
        assert r.n_turns == len(mine) and r.loss_chars == len(learned) and r.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{text}\n" for _, role, text in mine).encode()).hexdigest()
        assert r.formatted_chars == sum(len(chat.render(role, text)) for _, role, text in mine)
    assert chat.digests(chat.format_log(chat.event_log(df.where("false")))).count() == 0


def test_escapes_are_reversible():
    rng = random.Random(1)
    for _ in range(3000):
        t = "".join(rng.choice(["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", "s>", "/", "INST]", "x", "\n"]) for _ in range(rng.randint(0, 9)))
        e = chat.escape(t)
        assert chat.unescape(e) == t and not re.search(r"</?s>|\[/?INST\]", e)
        assert list(chat.read(chat.render("user", t) + chat.render("assistant", t))) == [("user", t, ""), ("assistant", t, t)]


def brute_mixture(sizes, targets):
    """How many copies a mixture takes of documents (id, source, size), by sorting each source's documents whole."""
    out = {}
    for source, target in targets.items():
        mine = [(i, n) for i, s, n in sizes if s == source and n]
        whole = int(target // sum(n for _, n in mine))
        rest, c = target - whole * sum(n for _, n in mine), None
        by_size = sorted({n for _, n in mine}, reverse=True)
        for n in by_size:  # the largest size that is not certain
            above, squares = sum(m for _, m in mine if m > n), sum(m * m for _, m in mine if m <= n)
            if (rest - above) / squares * n < 1:
                c, open_size = (rest - above) / squares, n
                break
        ranked = []
        for i, n in mine:
            u = (int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
            p = 1.0 if c is None or n > open_size else min(1.0, max(0.0, c * n))
            ranked.append((u * (1 - p) / (u * (1 - p) + (1 - u) * p), i, n))
        upto = 0
        for _, i, n in sorted(ranked):
            more = upto + n <= rest or (upto < rest and abs(upto + n - rest) < abs(upto - rest))
            upto += n
            out[i] = whole + more
    return out


def test_pipeline_stages(spark):
    """Every stage on what the one before kept, with odd rows among the documents, against brute force."""
    import corpus_pipeline as p
    from tessera.llm import mixing, quality
    from tessera.llm.common import pick, table
    from tests.llm.test_mixing import plain_targets

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = docs.where(F.length("text") > 300).orderBy("doc_id").first()
    odd = [(None, text.text, "en", None, 1), (90001, None, "en", "a", 0), (90002, "", None, "a", 0), (90003, text.text, "en", "a", 1), (90003, text.text, "en", "a", 1), (90004, "word " * 60_000, "en", "a", 300_000)]
    docs = docs.select(*p.COLUMNS).unionByName(spark.createDataFrame(odd, docs.select(*p.COLUMNS).schema)).withColumn("mix_place", F.lit(1)).withColumn("key", F.lit("k"))
    rows = {}
    for name, stage in p.STAGES:
        before, docs = docs, written(stage(spark, docs, sf), name)
        rows[name] = (before.collect(), docs.collect())
        if name != "tokens":
            assert tuple(docs.columns) == p.COLUMNS
    before, after = rows["quality"]
    model = quality.train(pick(spark.createDataFrame(before), *p.COLUMNS), table(spark, sf, "labels"), at=0.3)
    good = [r for r, s in zip(before, model.score(quality.features([r.text or "" for r in before]))) if s >= 0.3]
    assert Counter((r.doc_id, r.text) for r in after) == Counter((r.doc_id, r.text) for r in good) and len(good) < len(before)
    before, after = rows["near_duplicates"]
    ids = [r.doc_id for r in before]
    groups = brute_components([r.text for r in before], 5, 80, 100)
    least = {}
    for i, (n, c) in groups.items():
        place = (ids[i] is None, ids[i]) if n else (2, i)
        least[c] = min(least.get(c, place), place)
    assert Counter(r.doc_id for r in after if r.text and r.text.strip()) == Counter(i for last, i in least.values() if last != 2)
    before, after = rows["personal_data"]
    assert not any("@mail" in (r.text or "") for r in after) and Counter(r.doc_id for r in before) == Counter(r.doc_id for r in after)
    assert all(r.n_chars == len(r.text) for r in after if r.text is not None)
    before, after = rows["mixture"]
    sizes = [(r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in before]
    by_source = {}
    for _, s, n in sizes:
        by_source[s] = by_source.get(s, 0) + n
    copies = brute_mixture(sizes, {s: t for s, t in plain_targets(by_source).items() if by_source[s]})
    assert Counter(r.doc_id for r in after) == Counter({i: n for i, n in copies.items() if n})
    assert Counter(r.doc_id for r in rows["tokens"][1]) == Counter(r.doc_id for r in rows["mixture"][1])


def test_pipeline_of_nothing(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("false")
    for name, stage in p.STAGES:
        docs = written(stage(spark, docs, "/root/testdata/sf0.001"), name)
        assert docs.count() == 0
