"""Archives, the divergence audit and whitening against brute force."""

import base64
import gzip
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import divergence, queries, warc, whitening

PAGES = "page_id long, url string, html string, digest int, record_id string, salt int, payload string"


def odd_pages():
    """Copies of all numbers, empty and null payloads, record ends inside and at the ends of payloads, repeated rows, null ids and addresses."""
    rng = random.Random(4)
    texts = ["", None, "a", "\r\n", "\r\n\r\n", "x\r\n", "x\r\n\r\n", "x\r", "WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n", "größe € 你好\r\n\r\n\r\ny", "\n\r\n\r\n\r", "z" * 3_000_000]
    rows = [(i, f"http://h/{i} a\r\nX: y", texts[i % len(texts)]) for i in range(40)] + [(5, None, "again")] * 4 + [(None, "u", "again"), (None, "u", None), (-3, "u", "only here")]
    rows += [(100 + i, "u", "hot") for i in range(60)]
    rng.shuffle(rows)
    return rows


def brute_revisits(rows, min_bytes):
    held = defaultdict(list)
    for i, _, html in rows:
        held[(html or "").encode()].append(i)
    out = []
    for payload, ids in held.items():
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        ids = sorted(ids, key=lambda i: (i is None, i or 0))
        for k, i in enumerate(ids):
            again = k > 0 and len(payload) >= min_bytes
            out.append((i, len(payload), digest, "revisit" if again else "response", ids[0] if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_bytes", [0, 2, 4])
def test_revisits_are_those_of_brute_force(spark, min_bytes):
    rows = odd_pages()
    df = spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], PAGES).repartition(5)
    got = warc.round_trip(df, min_bytes)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_revisits(rows, min_bytes)


def test_archives_of_nothing(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_archives_hold_payloads_and_references(spark, tmp_path):
    """The deduplicated archive is read without this package: every response has its payload, every revisit leads to one that equals it."""
    rows = [r for r in odd_pages() if r[0] is not None and r[0] != 5]
    warc.write(warc.from_rows(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)), str(tmp_path / "a"))
    warc.deduplicate(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    responses, revisits = {}, []
    for f in (tmp_path / "b").glob("*.gz"):
        data = gzip.decompress(f.read_bytes())
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            n = int(fields["Content-Length"])
            assert rest[n : n + 4] == b"\r\n\r\n" and b32(rest[:n]) == fields["WARC-Block-Digest"]
            body = rest[:n].partition(b"\r\n\r\n")[2]
            if fields["WARC-Type"] == "response":
                assert b32(body) == fields["WARC-Payload-Digest"]
                responses[fields["WARC-Record-ID"]] = (body, fields)
            else:
                assert body == b""
                revisits.append(fields)
            data = rest[n + 4 :]
    given = {i: (html or "").encode() for i, _, html in rows}
    assert len(responses) == len(set(given.values())) and len(responses) + len(revisits) == len(rows)
    for f in revisits:
        body, of = responses[f["WARC-Refers-To"]]
        assert body == given[int(f["X-Row-Id"])] and f["WARC-Payload-Digest"] == of["WARC-Payload-Digest"]
        assert f["WARC-Refers-To-Target-URI"] == of["WARC-Target-URI"] and f["WARC-Refers-To-Date"] == of["WARC-Date"] and f["WARC-Profile"] == warc.PROFILE
    read = {r.row_id: bytes(r.payload) for r in warc.read(spark, str(tmp_path / "a")).collect()}
    assert read == given


def b32(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def foreign(kind, name, block, *fields):
    head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x:{name}>", "WARC-Date: 2020-01-01T00:00:00Z", *fields, f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_foreign_archives(spark, tmp_path):
    """Records in gzip members of their own, revisits with and without their original, other types, bytes that are no text."""
    body = b"\xff\xfe\x00bytes\r\n\r\n"
    http = "Content-Type: application/http; msgtype=response"
    records = [
        foreign("warcinfo", "i", b"software: x", "Content-Type: application/warc-fields", "WARC-Filename: f.warc.gz"),
        foreign("response", "r", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n" + body, http, "WARC-Target-URI: http://a/", "X-Row-Id: seven"),
        foreign("resource", "s", body, "WARC-Target-URI: http://b/"),
        foreign("revisit", "v", b"HTTP/1.1 200 OK\r\n\r\n", http, f"WARC-Payload-Digest: {b32(body)}", "WARC-Refers-To: <urn:x:gone>"),
        foreign("revisit", "w", b"", f"WARC-Payload-Digest: {b32(b'lost')}", "WARC-Refers-To: <urn:x:lost>"),
    ]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "1.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    warc.deduplicate(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    got = {r.record_id[7:-1]: r for r in warc.read(spark, str(tmp_path / "b")).collect()}
    assert {k: (r.record_type, r.refers_to, r.payload and bytes(r.payload)) for k, r in got.items()} == {
        "i": ("warcinfo", None, b"software: x"), "r": ("response", None, body), "s": ("revisit", "<urn:x:r>", None), "v": ("revisit", "<urn:x:r>", None), "w": ("revisit", "<urn:x:lost>", None),
    }
    assert got["i"].fields == ["WARC-Filename: f.warc.gz"] and got["r"].http == b"HTTP/1.1 200 OK\r\nA: b" and got["s"].refers_to_uri == "http://a/"
    resolved = {r.record_id[7:-1]: r.payload_bytes for r in warc.resolve(warc.read(spark, str(tmp_path / "b"), payloads=False)).collect()}
    assert resolved == {"i": 11, "r": len(body), "s": len(body), "v": len(body), "w": None}


def test_cut_off_archives_raise():
    good = foreign("resource", "s", b"body")
    assert [x[2] for x in warc.parse(iter([good[:30], good[30:], good]))] == [b"body", b"body"]
    with pytest.raises(ValueError, match="cut off"):
        list(warc.parse(iter([good[:-6]])))
    with pytest.raises(ValueError, match="no WARC record"):
        list(warc.parse(iter([b"<html>\r\n\r\n"])))


def odd_documents(seed=1, n=400):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "GAMMA", "straße", "ÄÖ", "日本", "e" * 30, *[f"w{chr(97 + i)}" for i in range(20)]]
    out = []
    for _ in range(n):
        lang = rng.choice(["en", "en", "en", "de", None, "xx"])
        source = rng.choice([None, "a", "b", "c", "ä", "Z", "src1", "src2", "src3", "src4"])
        base = words[:4] if source == "a" else words
        text = " ".join(rng.choice(base) + rng.choice(["", ".", "1", "_", "\x00"]) for _ in range(rng.randint(0, 12)))
        out.append((text if lang != "xx" else "12 34", lang, source))
    return out + [(None, "en", "silent"), ("", "fr", "alone"), (None, None, None)] + [("beta " * 50, "en", "a")] * 30


def brute_audit(docs, min_docs, ranks):
    seen, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in ([x or "" for x in d] for d in docs):
        terms = [t.translate({c: c + 32 for c in range(65, 91)}) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]
        groups.add((lang, source))
        counts[lang, source].update(terms)
        seen[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in seen[lang].items() if n >= min_docs)
        sources = [s for g, s in groups if g == lang]
        p = {}
        whole = sum((counts[lang, s] for s in sources), Counter())
        for s, c in [(s, counts[lang, s]) for s in sources] + [(("all",), whole)]:
            total = sum(c[t] for t in kept)
            p[s] = {t: 1 + 1_000_000_000 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - p[("all",)][t], t) for t in kept if counts[lang, s][t] and p[s][t] > p[("all",)][t]]
            for part, found, most in (("pair", pairs, math.inf), ("term", terms, ranks)):
                for k, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())), 1):
                    if k <= most:
                        out.append((lang, s, part, item, v, k))
    return sorted(out)


@pytest.mark.parametrize(("size", "seats", "min_docs", "ranks"), [(16384, 8, 3, 50), (4, 2, 3, 5), (3, 1, 30, 2), (4, 3, 10_000, 5)])
def test_audit_is_exact(spark, monkeypatch, size, seats, min_docs, ranks):
    monkeypatch.setattr(divergence, "SLICE", size)
    monkeypatch.setattr(divergence, "SEATS", seats)
    docs = odd_documents()
    df = spark.createDataFrame([(*d, 7, "x", 3) for d in docs], "text string, lang string, source string, value int, term string, block int").repartition(6)
    assert sorted(map(tuple, divergence.audit(df, min_docs, ranks).collect())) == brute_audit(docs, min_docs, ranks)


def test_audit_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_blocks_stay_where_they_are(spark):
    """The resident side of a meeting is read from the cache as it is partitioned; only visitors are shuffled."""
    df = spark.range(40).select(F.lit("l").alias("lang"), F.lit(0).alias("slice"), (F.col("id") % 4).cast("int").alias("block"), F.col("id").cast("string").alias("source"))
    seated = df.repartition(4, "lang", "slice", "block").persist()
    other = df.select(*[F.col(c).alias(c) for c in df.columns])
    met = seated.groupBy("lang", "slice", "block").cogroup(other.groupBy("lang", "slice", "block")).applyInArrow(lambda a, b: a, "lang string, slice int, block int, source string")
    plan = met._jdf.queryExecution().executedPlan().toString()
    seated.unpersist()
    outside = re.sub(r"(?s)\+- InMemoryRelation.*?(?=\n *[:+]- (?!.*InMemory)|\Z)", "", plan)
    assert outside.count("Exchange hashpartitioning") <= 2  # the visitors', and the one that made the cached table


def test_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 10)
    text = "Some words, of aVeryLongTermThatFillsPieces and\x00more" * 20
    assert [t for p in divergence.pieces(text) for t in p] == re.findall(rb"[a-z\x80-\xff]+", text.encode().lower())


def test_shares_are_exact_beyond_64_bits():
    for counts, total, terms in (([0, 3, 9], 12, 4), ([0, 10**12, 2**50], 2**52, 1000), ([2**30], 2**33, 1)):
        assert divergence.shares(np.array(counts), total, terms).tolist() == [1 + 10**9 * (c + 5) // (total + 5 * terms) for c in counts]
    assert divergence.shares(np.zeros(1, np.int64), 0, 0).tolist() == [0]


VECTORS = "vec_id long, embedding array<double>, x int, component string, n int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 5, "c", 6) for r in rows], VECTORS).repartition(4)


def check_whitening(got, rows, k, rtol=1e-9):
    """Rows against numpy's eigenvectors of the covariance, up to signs."""
    x = np.floor(1024 * np.array([r[1] for r in rows])).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    y = n * x.astype(object) - s.astype(object)
    c = (y / n).astype(float)
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    by_id = defaultdict(dict)
    for r in got:
        by_id[r.vec_id][r.component] = r
        assert r.n == n and r.explained == pytest.approx(e[r.component - 1] / e.sum(), rel=1e-9) and r.identity_error < 1e-9
    assert set(by_id) == {r[0] for r in rows} and all(sorted(d) == list(range(1, k + 1)) for d in by_id.values())
    exact = (y**2).sum(1)
    assert all(int(by_id[r[0]][1].deviation) == exact[i] for i, r in enumerate(rows))
    w = np.array([[by_id[r[0]][j].whitened for j in range(1, k + 1)] for r in rows])
    expected = c @ u[:, :k] / np.sqrt(e[:k])
    signs = np.sign((w * expected).sum(0))
    assert np.allclose(w * signs, expected, rtol=0, atol=rtol * np.abs(expected).max())


ODD = [(900, None), (901, []), (902, [float("nan")] * 12), (903, [None, *[1.0] * 11]), (904, [1.0] * 11 + [float("-inf")]), (905, [1.0, 2.0])]


def test_flat_spectra_expand_to_the_full_dimension(spark):
    rng = np.random.default_rng(1)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((300, 40)))]
    check_whitening(whitening.whiten(frame(spark, rows)).collect(), rows, 8, 1e-7)
    model = whitening.fit(frame(spark, rows).selectExpr("transform(embedding, x -> cast(floor(1024 * x) as long)) x"), 8)
    assert model.expanded and model.components.shape == (40, 8) and model.passes <= whitening.PASSES + 1


def test_falling_spectra_need_few_passes(spark):
    rng = np.random.default_rng(2)
    turn = np.linalg.qr(rng.standard_normal((40, 40)))[0]
    v = (rng.standard_normal((500, 40)) * 100.0 * 0.4 ** np.arange(40)) @ turn + 1000
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    check_whitening(whitening.whiten(frame(spark, rows)).collect(), rows, 8, 1e-7)
    model = whitening.fit(frame(spark, rows).selectExpr("transform(embedding, x -> cast(floor(1024 * x) as long)) x"), 8)
    assert not model.expanded and model.passes <= 8


def test_odd_vectors_take_no_part(spark):
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((60, 12)))]
    check_whitening(whitening.whiten(frame(spark, rows + ODD)).collect(), rows, 8)
    few = [(i, v[:3]) for i, v in rows]  # fewer dimensions than components
    check_whitening(whitening.whiten(frame(spark, few)).collect(), few, 3)
    again = whitening.whiten(frame(spark, rows + rows + [(None, rows[0][1])])).collect()  # repeated rows and a null id stay
    assert len(again) == 8 * 121 and sum(r.vec_id is None for r in again) == 8 and again[0].n == 121


def test_nothing_to_whiten(spark):
    for rows in ([], ODD[:5], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(5)]):
        assert whitening.whiten(frame(spark, rows)).count() == 0
    line = whitening.whiten(frame(spark, [(i, [float(i), 2.0 * i]) for i in range(5)])).collect()  # rank one: one component
    assert {r.component for r in line} == {1} and len(line) == 5


def test_large_numbers_stay_exact(spark):
    rows = [(i, [1e9 * (i % 3) + i, -3e8 * i, 1.0]) for i in range(30)]
    check_whitening(whitening.whiten(frame(spark, rows), k=2).collect(), rows, 2, 1e-6)
    y = np.array([[2**40, -(2**50)], [3, 4]])
    assert whitening.squares(y) == [2**80 + 2**100, 25]


def test_query_types(spark):
    got = queries.op13_whitening(spark, "/root/testdata/sf0.001")
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    assert got.where("deviation is null").count() == 0 and got.count() % 8 == 0
