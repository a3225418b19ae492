"""Tokens, personal data and quality: against a library, plain patterns and held-out labels."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import bpe, pii, quality

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", "a", "  ", "İstanbul ΣΑΣ ς", "<|endoftext|> a<|startoftext|>", "don't WE'LL 123 12.5 $%^", "a b​c﻿d", "日本語テスト", "😀😃 x", "\x00\x01 a\x1c b\u0085 z", "x" * 3000, "é é ẛ̣"]


def texts(n, alphabet, longest=60, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def test_bpe_matches_the_library(spark):
    given = ODD + texts(400, "aAbÉéßİΣ \t\n　 '!?.,<|>0123٣Ⅷ_-日😀́‍\x1c\x1f\x00ſK")
    lib = Tokenizer.from_file(VOCABULARY)
    lib.no_truncation()
    lib.no_padding()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(given)], "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in bpe.encode(df, VOCABULARY).collect()}
    digests = {r.doc_id: r for r in bpe.encode(df, VOCABULARY, digest=True).collect()}
    for i, t in enumerate(given):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].n_tokens == len(ids) == digests[i].n_tokens
        assert got[i].decoded == lib.decode(ids, skip_special_tokens=False)
        assert digests[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert bpe.encode(df.where("false"), VOCABULARY).count() == 0


def test_memory_of_pieces_is_bounded_and_changes_nothing(monkeypatch):
    given = texts(300, "abcde f", 80) + ["x" * 5000, "ab" * 4000 + " c", *texts(300, "abcdeé f", 80, 2)]
    plain = [[(p[0], p[1]) for p in parts] for parts in bpe.Bpe(VOCABULARY).encode_batch(given)]
    monkeypatch.setattr(bpe, "MEMORY", 50)
    monkeypatch.setattr(bpe, "MEMORY_CHARS", 3000)
    small = bpe.Bpe(VOCABULARY)
    for k, t in enumerate(given):
        assert [(p[0], p[1]) for p in small.encode_batch([t])[0]] == plain[k]
        assert len(small.memory) <= 50 + 200 and small.chars < 3000 + 60_000


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(len(p.lstrip("0")) > 3 or int(p.lstrip("0") or 0) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_are_those_of_the_patterns():
    given = texts(20000, "ab@.-+1234567890 ()[]é", 40) + texts(3000, "0123456789-. ", 60, 2)
    given += ["a@b.c@d.e", "x@@y.z", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "+1 (268) 555-6289.", "9" * 5000 + ".1.1.1"]
    for t in given:
        assert pii.base_spans(t) == plain_spans(t), t


def test_added_spans_and_clean_texts(spark):
    rows = [(1, "mail me: joe [at] example [dot] com now"), (2, "phone: 503-555-8963, thanks"), (3, "order 48158195160909 of 2024-01-05, version 1.2.3"), (4, None), (5, ""), (6, "joe@example.com"), (6, "joe@example.com")]
    got = [(r.doc_id, r.n_email, r.n_phone, r.spans, r.n_added) for r in pii.detect(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, spans int")).collect()]
    assert (1, 0, 0, "email:9:35", 1) in got and (3, 0, 0, "", 0) in got and (4, 0, 0, "", 0) in got and (5, 0, 0, "", 0) in got
    assert got.count((6, 1, 0, "email:0:15", 0)) == 2


def test_redaction():
    base = pii.base_spans("a joe@example.com b +1 (268) 555-6289")
    assert pii.redacted("a joe@example.com b +1 (268) 555-6289", base) == "a [EMAIL] b [PHONE]"


@pytest.fixture(scope="module")
def planted(tables):
    """A model, and windows of documents with one written-out or harmless text each, that it has not seen."""
    windows = pii.windows(tables[0])
    rng = random.Random(99)
    out = []
    for k in range(600):
        words = windows[k % len(windows)].split()
        at = rng.randint(0, len(words))
        if k % 2:
            cue, kind, s = pii.written_out(rng)
        else:
            (cue, s), kind = pii.harmless(rng), -1
        before = "".join(f"{w} " for w in words[:at]) + cue
        out.append((f"{before}{s} {' '.join(words[at:])}", kind, len(before), len(before) + len(s)))
    return pii.Model(windows), out


def test_planted_data_is_added_and_numbers_are_not(planted):
    model, given = planted
    found = pii.find([g[0] for g in given], model)
    caught = [any(s < g[3] and g[2] < e for s, _, e in added + base) for g, (base, added, *_) in zip(given, found)]
    good = [c for c, g in zip(caught, given) if g[1] >= 0]
    bad = [any(s < g[3] and g[2] < e for s, _, e in f[1]) for g, f in zip(given, found) if g[1] < 0]
    assert sum(good) / len(good) > 0.6 and sum(bad) / len(bad) < 0.03


def test_taken_spans_match_brute_force(planted):
    model, _ = planted
    rng = random.Random(4)
    for _ in range(200):
        text = " ".join(rng.choice((pii.written_out(rng)[2], pii.harmless(rng)[1], "+1 (268) 555-6289", "joe@example.com", "word")) for _ in range(12))
        base, added, scored, doubted = pii.find([text], model)[0]
        loose = pii.loose_spans(text)
        z = model.trees.score(np.array([pii.features(text, c) for c in loose])) if loose else np.zeros(0)
        kept = []
        for i in np.argsort(-z, kind="stable"):
            c = loose[i]
            if z[i] >= model.least[c[1]] and not any(c[0] < e and s < c[2] for s, _, e in base + kept):
                kept.append(c)
        assert base == plain_spans(text) and added == sorted(kept) and scored == len(base) + len(loose) and 0 <= doubted <= len(base)


def test_search_is_linear(planted):
    model, _ = planted
    for piece in ("a", "@", "1", "1.", "+1 ", "1-", "a@", "[at]"):
        pii.find([piece * 30000], model)
    text = "call (503) 555-8963, joe [at] example [dot] com or +1 (268) 555-6289 and joe@example.com; " * 11000
    began = time.time()
    base, added, *_ = pii.find([text], model)[0]
    assert len(base) == 22000 and len(added) >= 11000 and time.time() - began < 60


@pytest.fixture(scope="module")
def tables(spark):
    return [spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels")]


def test_held_out_accuracy(spark, tables):
    docs, labels = tables
    scored = quality.score(docs, quality.train(docs, labels))
    rows = scored.join(labels, "doc_id").select("doc_id", "quality", "quality_score").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    right = sum((r.quality_score >= 0.3) == (r.quality == 1) for r in held)
    assert right / len(held) > 0.97
    assert all(0 <= r.quality_score <= 1 for r in rows)


def test_quality_of_odd_texts(spark, tables):
    docs, labels = tables
    model = quality.train(docs, labels)
    odd = spark.createDataFrame([(1, None, 3.0), (2, "", 3.0), (3, "x" * 100_000, 3.0), (4, "\n" * 50, 3.0)], "doc_id long, text string, quality_score double")
    got = quality.score(odd, model).collect()
    assert len(got) == 4 and all(0 <= r.quality_score <= 1 for r in got)
    assert quality.score(odd.where("false"), model).count() == 0


def test_without_labels_all_scores_are_one_half(spark, tables):
    docs, labels = tables
    model = quality.train(docs, labels.where("false"))
    assert {r.quality_score for r in quality.score(docs.limit(5), model).collect()} == {0.5}


def test_repeated_ids_teach_once_and_ties_score_alike(spark, tables):
    docs, labels = tables
    many = docs.unionByName(docs.where("doc_id < 40").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(50)))).drop("n"))
    a, b = quality.train(docs, labels), quality.train(many, labels.unionByName(labels))
    assert np.array_equal(a.weights, b.weights) and a.cut == b.cut
    scores = {}
    for r in quality.score(many.where("doc_id < 40"), a).collect():
        scores.setdefault(r.text, set()).add(r.quality_score)
    assert all(len(s) == 1 for s in scores.values())


def test_pairs_are_ranked_as_brute_force_ranks_them():
    """Weights against plain gradient descent on the same preference pairs, and the cut against a sorted list."""
    rng = np.random.default_rng(1)
    x, true = rng.standard_normal((300, 4)), np.array([2.0, -1.0, 0.5, 0.0])
    y = (x @ true + 0.3 * rng.standard_normal(300) > 0.4).astype(int)
    model = quality.fit(x, y, pairs=3000)
    z = np.clip((x - x.mean(0)) / (x.std(0) + 1e-6), -8, 8)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    pick = np.random.default_rng(3)
    d = z[pick.choice(good, 3000)] - z[pick.choice(bad, 3000)]
    w = np.zeros(4)
    for _ in range(30000):
        w -= 0.01 / 30 * (w - d.T @ (1 / (1 + np.exp(d @ w))))
    assert np.abs(w - model.weights).max() < 0.02
    raw = np.sort(z @ model.weights)
    assert model.cut == pytest.approx(np.interp(len(bad) / 300 * 299, np.arange(300), raw))
    assert ((model.score(x) >= 0.3) == (model.raw(x) >= model.cut - 1e-9)).all()
