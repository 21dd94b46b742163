"""Prefix hashes against plain string comparisons; documents and their next against a sorted list."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from hexcadence.llm import prefixhash
from hexcadence.llm.prefixhash import Fingerprint, Prefix, likeness
from hexcadence.llm.workload import op13_prefix_fingerprints
from tests.llm.frames import empty_docs, hard_docs, prose

COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def longest(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def test_spans_and_extensions_equal_string_comparisons():
    r = random.Random(1)
    texts = ["", "a", "aaaaaaaaaa", "é漢😀\x00x", "".join(r.choice("ab") for _ in range(200)), "".join(r.choice("ab\x00") for _ in range(300))]
    texts.append(texts[4][50:150] + texts[5][:120])
    for a in texts:
        for b in texts:
            x, y = Prefix(a), Prefix(b)
            for _ in range(60):
                i, j, m = r.randrange(len(a) + 1), r.randrange(len(b) + 1), r.randrange(12)
                fits = i + m <= len(a) and j + m <= len(b)
                assert x.equal(i, y, j, m) == (fits and a[i : i + m] == b[j : j + m])
                assert x.extension(i, y, j) == longest(a[i:], b[j:])
                assert x.extension_back(i, y, j) == longest(a[:i][::-1], b[:j][::-1])
                if fits:
                    assert (x.span(i, i + m) == y.span(j, j + m)) == (a[i : i + m] == b[j : j + m])


def plain(text):
    """Places and prefix hashes, window by window, in Python integers."""
    p, n, w = prefixhash.PRIME, len(text), prefixhash.WINDOW
    codes = [ord(c) + 1 for c in text]
    value = lambda i, j, b: sum(c * pow(b, k, p) for k, c in enumerate(codes[i:j])) % p
    first = {}
    for i in range(w, n + 1):
        a, b = (value(i - w, i, base) for base in prefixhash.BASES)
        x = (a << 31) | b
        x = ((x ^ (x >> 29)) * 0x9E3779B97F4A7C15) % (1 << 64)
        first.setdefault(min((x ^ (x >> 32)) & 0xFFFFFFFF, (1 << 32) - 2), i)
    kept = sorted(first)[: prefixhash.PLACES]
    at = {first[v] for v in kept} | {0, n}
    if n < w + prefixhash.PLACES:
        at = set(range(n + 1))
    return [(i, tuple(value(0, i, b) for b in prefixhash.BASES)) for i in sorted(at)]


@pytest.mark.parametrize("size", [1 << 18, 64, 17])
def test_fingerprint_places_and_slices(monkeypatch, size):
    monkeypatch.setattr(prefixhash, "SLICE", size)
    for text in ("", "a", "ab" * 4, "x" * 43, "x" * 44, "x" * 400, prose(1, 3), prose(2, 9), prose(3, 90), "é漢😀" * 30, prose(4, 150) + "\x00"):
        f = Fingerprint.of(text)
        assert list(zip(f.at, f.hashes, strict=True)) == (plain(text) if text else [(0, (0, 0)), (0, (0, 0))])
        again = Fingerprint.unpacked(f.packed())
        assert (again.n, again.limit, again.at, again.strength, again.hashes) == (f.n, f.limit, f.at, f.strength, f.hashes)


def test_likeness_follows_shared_text():
    of = Fingerprint.of
    words = lambda seed, n: " ".join(f"w{random.Random(seed * 100_000 + i).randrange(10**6)}" for i in range(n))
    for n in (3, 8, 20, 100, 3000):
        a, b = words(1, n), words(2, n)
        assert likeness(of(a), of(a)) == 1.0
        assert likeness(of(a), of(b)) < 0.15
        new = prefixhash.edited(a, b)
        assert 0.6 < likeness(of(a), of(new)) <= 0.87
        assert 0.6 < likeness(of(b + a), of(a)) / (2 * len(a) / len(a + b + a)) < 1.01 or n < 20
        turned = a[len(a) // 2 :] + a[: len(a) // 2]
        assert n < 100 or likeness(of(a), of(turned)) > 0.75
    assert likeness(of(""), of("")) == 1.0
    assert likeness(of(""), of("a")) == likeness(of("a"), of("")) == 0.0
    assert likeness(of("abcdefg"), of("gfedcba")) < 0.3
    # Few windows, all in the first round: the rest is one span, and it differs.
    assert 0 < likeness(of("same text " * 40), of("same text " * 41)) < 0.2


def expected(rows):
    """rows: (id, text); by id, nulls last."""
    texts = sorted(((i is None, i or 0), i, t or "") for i, t in rows)
    out = []
    for n, (_, i, t) in enumerate(texts):
        after = texts[(n + 1) % len(texts)][2]
        k = len(t) // 4
        new = t[: len(t) - k] + after[:k]
        a, b, c = Fingerprint.of(t), Fingerprint.of(new), Fingerprint.of(after)
        out.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), a.packed(), b.packed(), likeness(a, b), likeness(a, c)))
    return out


def key(r):
    return tuple((x is None, x or 0) for x in r)


@pytest.mark.parametrize("parts", ["1", "8", "90"])
def test_query_equals_sorted_list(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        sf = "/root/testdata/sf0.001"
        got = op13_prefix_fingerprints(spark, sf)
        assert got.columns == COLUMNS
        rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
        assert sorted(map(tuple, got.collect()), key=key) == sorted(expected(rows), key=key)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_hard_rows(spark):
    docs = hard_docs(spark)
    got = prefixhash.compared(docs, "doc_id", "text").collect()
    assert len(got) == docs.count()
    assert sorted(r["n_chars"] for r in got) == sorted(len(r["text"] or "") for r in docs.collect())
    by = {}
    for r in got:
        by.setdefault((r["id"], r["n_chars"]), []).append(r)
    assert by[(9, 400)][0]["fingerprint"] == by[(10, 400)][0]["fingerprint"]
    assert by[(9, 400)][0]["near_next"] == 1.0
    assert by[(3, 0)][0]["near_next"] == 1.0  # null and empty
    assert prefixhash.compared(empty_docs(spark), "doc_id", "text").collect() == []
    one = prefixhash.compared(docs.where("doc_id = 7"), "doc_id", "text").collect()
    assert [r["near_next"] for r in one] == [1.0]
    same = spark.range(500).select(F.lit(4).alias("doc_id"), F.lit("again and again, the same row").alias("text"))
    assert [tuple(r) for r in prefixhash.compared(same, "doc_id", "text").select("near_edited", "near_next").distinct().collect()][0][1] == 1.0
    assert prefixhash.compared(same, "doc_id", "text").count() == 500


def test_ids_with_many_rows_are_split(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 != 0, F.col("id")).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    places = prefixhash.with_next(rows, "doc_id", "text")
    most = places.groupBy("part").count().agg(F.max("count")).first()[0]
    assert most < 600
    assert places.where("follows = 0").count() == 3000
    ends = places.groupBy("part").agg(F.sum("follows").alias("n"), F.count_if(F.col("follows") == 0).alias("own"))
    assert ends.where("n != 1 OR own = 0").count() == 0
