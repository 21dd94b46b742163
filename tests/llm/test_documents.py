"""Shards, quality rules, personal data and mixing against brute force, and on hard rows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hexcadence.llm import mixing, pii, quality, sharding
from hexcadence.llm.base import stored
from hexcadence.llm.workload import op3_bootstrapped_pii, op6_cube_mixing, op7_divergence
from tests.llm.frames import empty_docs, hard_docs, prose

SF = "/root/testdata/sf0.001"


# --- shards -----------------------------------------------------------------------------------------


@pytest.mark.parametrize(("n_shards", "partitions"), [(16, None), (3, 5), (40, 2)])
def test_shards_are_contiguous_and_balanced(spark, n_shards, partitions):
    docs = hard_docs(spark).withColumn("size", sharding.text_bytes(F.col("text")))
    rows = [r.asDict() for r in sharding.shards(docs, ["doc_id", "text"], "size", n_shards, partitions).collect()]
    assert len(rows) == docs.count() and set(rows[0]) == set(docs.columns)
    rows.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] is None, r["text"] or ""))
    whole, start = sum(r["size"] for r in rows), 0
    for r in rows:
        assert r["shard"] == min(n_shards - 1, (2 * start + r["size"]) * n_shards // (2 * whole))
        start += r["size"]
    for k in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(sum(r["shard"] == k for r in rows)))
    assert sharding.shards(docs.limit(0), ["doc_id"], "size", n_shards).count() == 0


def test_numbers_without_gaps_for_one_key(spark):
    df = spark.range(500).select(F.lit(1).alias("k"), F.col("id").alias("row_was"))
    assert sorted(r["n"] for r in sharding.numbered(df, ["k"], "n", 7).collect()) == list(range(500))


# --- quality ----------------------------------------------------------------------------------------

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    words = WORDS.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    repeated = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(repeated), n < 50 or 100 * len(repeated) > 50 * n


def test_base_counts_equal_brute_force():
    r, refs = random.Random(6), quality.References({None: np.zeros(11)}, {None: {}})
    for _ in range(400):
        text = "".join(r.choice(["a", "b", "a b c ", " ", "\n", "x|", "\x1c", "\xa0", "\t", "é", "*"]) for _ in range(r.randint(0, 150)))
        assert quality.judge(text, None, refs, quality.Rules())[:6] == plain_counts(text)


def test_distance_bounds():
    a, b = np.array([1.0, 0, 0]), np.array([0, 2.0, 2.0])
    assert quality.distance(a, a * 7) == 0 and quality.distance(a, b) == pytest.approx(1)
    assert quality.distance(a, np.zeros(3)) == 0
    assert quality.distance(a + b, b) == pytest.approx(quality.distance(b, a + b)) != 0


def test_references_equal_brute_force(spark):
    rules = quality.Rules(common_share=0.03, own_reference_share=0.2)
    rows = [(i, prose(i, 60 + i), ["en", "de", None][i % 3]) for i in range(30)] + [(99, prose(1, 70), "rare"), (100, "too short", "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4)
    refs = quality.references(docs, "text", "lang", rules)
    long = [(t, k) for _, t, k in rows if len(WORDS.findall(t)) >= 50]
    assert set(refs.classes) == {"en", "de", None} == set(refs.common)
    for key in refs.classes:
        texts = [t for t, k in long if key is None or k == key]
        words = Counter(w for t in texts for w in WORDS.findall(t))
        assert refs.common[key] == pytest.approx({w: n / words.total() for w, n in words.items() if n / words.total() >= 0.03})
        assert refs.classes[key].tolist() == sum(quality.class_counts(t) for t in texts).tolist()
    assert refs.of("rare") is None and refs.of("en") == "en"


def test_flush_keeps_counts(spark):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([prose(i, 60) for i in range(20)]), pa.array(["en"] * 20)], names=["text", "lang"])
    total = Counter()
    for out in quality._count_words("text", "lang", 50, held=3)(iter([batch, batch])):
        for r in out.to_pylist():
            total[r["word"], r["class"]] += r["n"]
    words = Counter(w for i in range(20) for w in WORDS.findall(prose(i, 60)))
    assert {w: n for (w, _), n in total.items() if w} == {w: 2 * n for w, n in words.items()}


def test_query_and_verdicts(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op7_divergence(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert tuple(r)[1:7] == plain_counts(docs[r["doc_id"]]["text"])
        assert not (r["base_failed"] and r["kept"])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    judged = [r for r in rows if r["doc_id"] in labels and not r["base_failed"]]
    good = [r["kept"] for r in judged if labels[r["doc_id"]] == 1]
    junk = [r["kept"] for r in judged if labels[r["doc_id"]] == 0]
    assert np.mean(good) > 0.99 and np.mean(junk) < 0.1


def test_rare_languages_are_judged_by_themselves(spark):
    """Verdicts on a rare language don't change when another language grows, and its junk still fails."""
    greek = str.maketrans("abcdefghijklmnopqrstuvwxyz", "αβψδεφγηιξκλμνοπθρστυωςχυζ")
    rows = [(i, prose(i, 400).translate(greek), "el") for i in range(30)] + [(50, " ".join(f"{i}#{i}" for i in range(300)), "el")]
    rows += [(i, prose(i, 400), "en") for i in range(100, 130)] + [(i, prose(i, 120).translate(greek), "xx") for i in range(200, 203)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    more = spark.range(1000, 1400).select("id", F.lit(prose(9, 40_000)), F.lit("en"))
    small, large = (
        {r["doc_id"]: tuple(r["quality"]) for r in quality.assess(d, "text", "lang").where("doc_id < 1000").collect()}
        for d in (docs, docs.union(more))
    )
    assert quality.references(docs.union(more), "text", "lang", quality.Rules()).of("el") is None
    assert len(small) == len(large) == len(rows)
    for k, _, lang in rows:
        if lang != "en":
            assert small[k] == pytest.approx(large[k]) and large[k][-1] == (k != 50), k
    assert all(large[k][6:8] == (None, None) for k in range(200, 203)) and large[0][7] is not None


def test_quality_hard_rows(spark):
    docs = hard_docs(spark)
    out = quality.assess(docs, "text", "lang")
    assert sorted(out.columns) == sorted(docs.columns) and out.count() == docs.count()
    for r in out.collect():
        assert tuple(r["quality"])[:6] == plain_counts(r["text"])
    assert quality.assess(empty_docs(spark), "text", "lang").count() == 0


# --- personal data ----------------------------------------------------------------------------------

FORMS = [re.compile(x) for x in (pii.EMAIL, pii.IP, pii.CARD, pii.PHONE)]


def plain_spans(text):
    out = []
    for k, form in enumerate(FORMS):
        for m in form.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if k == 1 and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if k == 2 and not (13 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if k == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((k, *m.span()))
    return out


def test_base_spans_equal_the_forms():
    r = random.Random(3)
    parts = [*"ab.@-%+ 019()\n", "a@b.c", "1.2.3.4", "+1 ", "4111 1111 1111 1111", "é", "000", "256", "٣", "😀"]
    for _ in range(30_000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 24)))
        assert pii.base_spans(text) == plain_spans(text), text
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.base_spans("1." + "0" * 5000 + "1.2." + "9" * 5000) == []
    # Long runs take one pass each.
    for text in ("1" * 300_000, "1." * 150_000, "x" * 300_000 + " 1@", "a" * 300_000 + "@" + "b" * 300_000, "1@" * 100_000):
        assert pii.occurrences(text) is not None and len(pii.base_spans(text)) in (0, 37_500)


def taught(spark):
    """Texts that teach 'write to' for mail and 'ring me' for phones, with identifiers the forms don't know."""
    rows = [f"{prose(i, 8)} please write to user{i}@mail.example.com {prose(i + 50, 5)}" for i in range(6)]
    rows += [f"{prose(i, 8)} you may ring me +1 (555) 010-{1000 + i} {prose(i + 50, 5)}" for i in range(6)]
    rows += [f"{prose(70, 9)} please write to root@localhost, {prose(71, 4)}", f"x you may ring me 555-010-7777 {prose(3, 3)}"]
    rows += [f"{prose(i, 6)} the cat {i}@nothing and sat 123-456-{i:04} on" for i in range(4)]
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)] + [(99, rows[12])], "doc_id bigint, text string")


def test_contexts_discover_unseen_identifiers(spark):
    docs = taught(spark)
    rows = {r["doc_id"]: r for r in pii.find(docs, "text").collect()}
    added = {k: [r["text"][s["start"] : s["end"]] for s in r["pii"]["spans"] if s not in r["pii"]["base"]] for k, r in rows.items()}
    assert {k: v for k, v in added.items() if v} == {12: ["root@localhost"], 13: ["555-010-7777"], 99: ["root@localhost"]}
    assert [s["kind"] for s in rows[12]["pii"]["spans"]] == [0] and [s["kind"] for s in rows[13]["pii"]["spans"]] == [3]
    masked = {r["doc_id"]: r["text"] for r in pii.mask(docs, "text").collect()}
    assert "write to [EMAIL]," in masked[12] and "ring me [PHONE] " in masked[13] and "[EMAIL]" in masked[0]
    assert masked[14] == rows[14]["text"]


def test_a_second_round_reaches_further(spark):
    """'via dept' never precedes an entity; it becomes a pattern because what 'write to' found also stands there."""
    rows = [f"{prose(i, 4)} please write to user{i}@mail.example.com" for i in range(9)]
    rows += [f"{prose(i, 4)} please write to node{i}@intra" for i in range(3)]
    rows += [f"{prose(i, 4)} sent via dept node{i}@intra {prose(i, 2)}" for i in range(3)] * 2
    rows += [f"{prose(1, 4)} sent via dept fresh@intra {prose(2, 2)}"]
    docs = spark.createDataFrame([(t,) for t in rows], "text string")
    for rounds, want in ((1, False), (3, True)):
        limits = pii.Bootstrap(rounds=rounds)
        out = pii.find(docs, "text", pii.discover(docs, "text", limits)).collect()
        assert any("fresh" in r["text"] and r["pii"]["spans"] for r in out) == want


def test_a_large_table_needs_no_more_values(spark):
    """One text of many identifiers in 450 copies doesn't raise the number of values that another context needs."""
    rows = [f"{prose(i, 8)} please write to user{i}@mail.example.com {prose(i + 50, 5)}" for i in range(3)]
    rows += [f"{prose(70, 9)} please write to root@localhost, {prose(71, 4)}"]
    many = " ".join(f"{w} of box{i}@mail.example.com" for i, w in enumerate(prose(5, 500).split()))
    docs = spark.createDataFrame([(t,) for t in rows], "text string")
    for df in (docs, docs.union(spark.range(450).select(F.lit(many)))):
        out = pii.find(df, "text").where("text LIKE '%root@%'").collect()
        assert [[r["text"][s["start"] : s["end"]] for s in r["pii"]["spans"]] for r in out] == [["root@localhost"]]


@pytest.mark.parametrize("full", [False, True])
def test_context_counts_equal_brute_force(spark, full):
    texts = [prose(i, 5 + i) for i in range(60)] + [None, "", "é漢😀 x y", "one"]
    words = [WORDS.findall(t or "")[:-1] for t in texts]
    want = Counter(w for x in words for w in x) + Counter(f"{a} {b}" for x in words for a, b in zip(x, x[1:], strict=False))
    patterns = sorted(want)[::3] + ["not there", "nowhere"]
    bits = pii._filter_of(spark.createDataFrame([(p,) for p in patterns], "pattern string").repartition(3))
    if full:  # every bit set, as by very many patterns
        bits = ~np.zeros_like(bits)
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    got = Counter()
    for r in df.mapInArrow(pii._count_contexts(bits, held=7), "pattern string, n bigint").collect():
        got[r["pattern"]] += r["n"]
    assert got == want if full else {p: got[p] for p in patterns} == {p: want[p] for p in patterns}


def test_contexts_behind_long_words_and_gaps():
    for gap in ("https://" + "x" * 115 + " email: ", "two" + " " * 200 + "email: ", "z" * 500 + " email:" + "\t" * 130):
        (found,) = pii.occurrences(gap + "root@localhost")
        assert found[5] == "email:" and found[6].endswith(" email:") and len(found[6]) <= 130


def test_rounds_go_on_until_scores_settle(spark):
    rows = [f"{prose(i, 4)} please write to user{i}@mail.example.com" for i in range(9)]
    rows += [f"{prose(i, 4)} please write to v0n{i}@intra" for i in range(3)]
    for k in range(5):
        rows += [f"{prose(i, 4)} via{k} dept{k} v{k}n{i}@intra {prose(i, 2)}" for i in range(3)] * 3
        rows += [f"{prose(i, 4)} via{k} dept{k} v{k + 1}n{i}@intra {prose(i, 2)}" for i in range(3)]
    docs = spark.createDataFrame([(t,) for t in rows], "text string")
    assert all(r["pii"]["spans"] for r in pii.find(docs, "text").collect())


def test_redact():
    assert pii.redact("a b@c.de f", [(0, 2, 8)]) == "a [EMAIL] f"
    assert pii.redact("0123456789", [(2, 0, 6), (3, 4, 8), (1, 0, 3)]) == "[CARD]89"
    assert pii.redact(None, []) is None and pii.redact("x", []) == "x"


def test_pii_query_equals_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op3_bootstrapped_pii(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        spans = plain_spans(docs[r["doc_id"]])
        assert tuple(r)[1:5] == tuple(sum(s[0] == k for s in spans) for k in range(4))
        listed = [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans]
        assert r["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(r["spans"].split(",")) or not listed


def test_pii_hard_rows(spark):
    docs = hard_docs(spark)
    found = pii.find(docs, "text", into="spans")
    assert set(docs.columns) | {"spans"} == set(found.columns) and found.count() == docs.count()
    masked = pii.mask(docs, "text")
    assert masked.columns == docs.columns and sorted(map(str, masked.collect())) == sorted(map(str, docs.collect()))
    assert pii.find(empty_docs(spark), "text").count() == 0


# --- mixing -----------------------------------------------------------------------------------------


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    whole, capped = sum(sizes.values()), set()
    while True:
        rest = whole - sum(3 * sizes[s] for s in capped)
        share = {s: rest * weight[s] / sum(weight[t] for t in names if t not in capped) for s in names if s not in capped}
        over = {s for s, t in share.items() if t > 3 * sizes[s]}
        if not over:
            return share | {s: 3.0 * sizes[s] for s in capped}
        capped |= over


def test_targets(spark):
    r = random.Random(8)
    for _ in range(4):
        sizes = {s: r.choice([0, 1, 5, 50, 500, 5000]) for s in r.sample(["a", "B", "é", "z", "src1", "src10", "src2", "", None], 6)}
        sizes["big"] = 3000
        df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size bigint")
        got = {x["source"]: x["target"] for x in mixing.targets(df, "source", "size").collect()}
        assert got == pytest.approx(plain_targets(sizes))


def test_flight_keeps_sums_and_leaves_two():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 50, 400):
        for sizes in (rng.integers(0, 1000, n), np.full(n, 7), np.r_[50_000, np.full(n - 1, 3)], np.zeros(n)):
            prob = np.where(rng.random(n) < 0.1, 0.0, rng.random(n))
            out = mixing.flight(prob, sizes.astype(float), np.random.default_rng(1))
            assert out.sum() == pytest.approx(prob.sum()) and out @ sizes == pytest.approx(prob @ sizes)
            assert ((out > 0) & (out < 1)).sum() <= 2 and (out >= 0).all() and (out <= 1).all()
            assert set(mixing.land(out, sizes.astype(float))) <= {0.0, 1.0}


def test_flight_is_unbiased():
    prob, sizes = np.array([0.2, 0.5, 0.7, 0.4, 0.9, 0.3]), np.array([5.0, 80.0, 3.0, 20.0, 11.0, 9.0])
    runs = [mixing.flight(prob, sizes, np.random.default_rng(s)) for s in range(4000)]
    assert np.abs(np.mean(runs, axis=0) - prob).max() < 0.04


def test_mix_query(spark):
    rows = op6_cube_mixing(spark, SF).collect()
    docs = {r["doc_id"]: (r["source"], len(WORDS.findall(r["text"] or ""))) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(docs) and sorted(map(tuple, rows)) == sorted(map(tuple, op6_cube_mixing(spark, SF).collect()))
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        source, size = docs[r["doc_id"]]
        assert r["size"] == size and 0 <= r["copies"] <= 3 and r["taken"] == size * r["copies"]
        sizes[source] += size
        taken[source] += r["taken"]
        target[source] = r["target"]
    assert target == pytest.approx(plain_targets(sizes))
    assert all(abs(taken[s] - target[s]) <= 0.1 * target[s] for s in target)


@pytest.mark.parametrize("block", [4096, 8])
def test_mix_many_blocks(spark, block):
    r = random.Random(2)
    rows = [(i, r.choice(["hot"] * 5 + ["a", "b", None]), r.randint(0, 300)) for i in range(600)] + [(7, "hot", 5)] * 3
    df = spark.createDataFrame(rows, "doc_id bigint, source string, size bigint")
    out = mixing.mix(df, "source", "size", ["doc_id"], block=block).collect()
    assert len(out) == len(rows)
    for s in ("hot", "a", "b", None):
        got = sum(x["size"] * x["copies"] for x in out if x["source"] == s)
        assert abs(got - next(x["target"] for x in out if x["source"] == s)) <= 300


def test_mix_hard_rows(spark):
    docs = hard_docs(spark).withColumn("size", mixing.word_count(F.col("text")))
    out = stored(mixing.mix(docs.select("doc_id", "source", "size", "copies", "row"), "source", "size", ["doc_id"]), "t")
    assert out.count() == docs.count() and set(out.columns) == {"doc_id", "source", "size", "row", "source_size", "target", "copies"}
    assert mixing.mix(docs.limit(0).select("doc_id", "source", "size"), "source", "size", ["doc_id"]).count() == 0
    nothing = spark.createDataFrame([(1, "a", None), (2, None, 0)], "doc_id bigint, source string, size bigint")
    assert [r["copies"] for r in mixing.mix(nothing, "source", "size", ["doc_id"]).collect()] == [0, 0]
