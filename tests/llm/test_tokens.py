"""BPE against the tokenizers library, and token counts against its offsets."""

import hashlib
import random
from functools import cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hexcadence.llm import bpe, tokencounts
from hexcadence.llm.workload import op1_bpe, vocabulary
from tests.llm.frames import empty_docs, hard_docs, prose

SF = "/root/testdata/sf0.001"
PATH = vocabulary()
PARTS = ["a", " ", "  ", "\n", "'s", "'", "'l", "l", "-", "=", "the", "é", "漢字", "😀", "12", " \n", "\t", "\xa0", "<|endoftext|>", "<|end", "!!", "\x00", "̀", "ing"]


@cache
def load():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def library():
    return load()


def ids(library, text):
    return np.array(library.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=60).map("".join) | st.text(max_size=60))
def test_encode_and_decode_equal_the_library(text):
    want = ids(load(), text)
    for limits in ({}, {"chunk": 16, "window": 8, "short": 4}, {"chunk": 5, "window": 1, "short": 0}):
        assert bpe.Encoder(PATH, **limits).batch([text]) == [want]
    assert bpe.Decoder(PATH, block=3).text(want) == text


def test_long_pieces_need_only_the_lookahead(library):
    r = random.Random(5)
    texts = ["a" * 9000, " " * 9000 + "x", "-" * 5000, "漢字" * 2000, "".join(r.choice("etaoinsh") for _ in range(9000))]
    assert bpe.Encoder(PATH, chunk=1000, window=64).batch(texts) == [ids(library, t) for t in texts]
    merges = bpe.merges(PATH)
    machine = bpe.Transducer(merges, merges.lookahead, window=10)
    for _ in machine.feed(texts[-1].encode()):
        assert len(machine.held) <= 10 + merges.lookahead + int(merges.lengths.max())


def test_any_ids_decode_like_the_library(library):
    r = random.Random(1)
    decoder = bpe.Decoder(PATH, block=4)
    for _ in range(300):
        some = [r.randrange(50257) for _ in range(12)]
        assert decoder.text(np.array(some, "<u4").tobytes()) == library.decode(some, skip_special_tokens=False)
    assert decoder.text(np.array([4_000_000_000], "<u4").tobytes()) == ""


def test_cache_may_be_cleared(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 5)
    texts = [prose(i, 50) + "<|endoftext|>" for i in range(5)]
    assert bpe.Encoder(PATH).batch(texts) == [ids(library, t) for t in texts]


def test_query_equals_the_library(spark, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op1_bpe(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        packed = ids(library, texts[r["doc_id"]])
        text = library.decode(np.frombuffer(packed, "<u4").tolist(), skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(packed) // 4, hashlib.sha256(packed).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_hard_rows(spark, library):
    docs = hard_docs(spark)
    back = bpe.decode(bpe.encode(docs, "text", PATH).select("*", "tokens.token_ids"), "token_ids", PATH, into="again")
    rows = back.collect()
    assert len(rows) == docs.count() and set(docs.columns) - {"tokens"} <= set(back.columns)
    for r in rows:
        assert r["again"] == (r["text"] or "") and bytes(r["token_ids"]) == ids(library, r["text"])
    assert bpe.encode(empty_docs(spark), "text", PATH).count() == 0


# --- sections ---------------------------------------------------------------------------------------


def brute(library, text, spans, rule):
    counts, crossing = [0.0] * len(spans), [0] * len(spans)
    for a, b in library.encode(text, add_special_tokens=False).offsets:
        inside = [max(0, min(b, e) - max(a, s)) for s, e in spans]
        met = [k for k, n in enumerate(inside) if n]
        for k in met:
            crossing[k] += inside[k] < b - a
        if not met:
            continue
        if rule == "split":
            for k in met:
                counts[k] += inside[k] / sum(inside)
        else:
            counts[met[0] if rule == "first" else max(met, key=lambda k: (inside[k], -k))] += 1
    return counts, crossing


@pytest.mark.parametrize("rule", tokencounts.RULES)
def test_allocation_equals_brute_force(library, rule):
    encoder = bpe.Encoder(PATH)
    r = random.Random(3)
    for _ in range(200):
        text = "".join(r.choice([*PARTS[:18], "\n\n", "\n"]) for _ in range(r.randint(0, 40)))
        cuts = sorted(r.sample(range(len(text) + 1), min(len(text) + 1, r.randint(0, 6))))
        for spans in (tokencounts.line_spans(text), list(zip(cuts, cuts[1:], strict=False)), list(zip(cuts[::2], cuts[1::2], strict=False))):
            packed = encoder.batch([text])[0]
            got = tokencounts.allocate(*tokencounts.token_spans(text, packed, encoder.merges.lengths), np.array(spans, np.int64).reshape(-1, 2), rule)
            want = brute(library, text, spans, rule)
            assert np.allclose(got[0], want[0]) and got[1].tolist() == want[1], (text, spans)


def test_lines_add_up_and_hard_rows(spark, library):
    docs = hard_docs(spark)
    out = tokencounts.attribute(docs.withColumn("row", F.monotonically_increasing_id()), "text", PATH)
    assert set(docs.columns) <= set(out.columns)
    sums = {r["row"]: (r["n"], r["text"]) for r in out.groupBy("row", "text").agg(F.sum("section.tokens").alias("n")).collect()}
    assert len(sums) == docs.count()
    assert all(n == len(ids(library, t)) // 4 for n, t in sums.values())
    assert tokencounts.attribute(empty_docs(spark), "text", PATH).count() == 0
    with pytest.raises(ValueError):
        tokencounts.attribute(docs, "text", PATH, rule="last")


def test_fields(spark, library):
    docs = tokencounts.field_sections(hard_docs(spark, extra=False), ["source", "lang", "text"])
    out = tokencounts.attribute(docs, "document", PATH, "sections", rule="split").where("doc_id = 6").collect()
    assert [r["section"]["number"] for r in out] == [0, 1, 2]
    assert sum(r["section"]["tokens"] for r in out) == pytest.approx(len(library.encode("b\nfr\né漢😀 x").ids))
    null = docs.withColumn("sections", F.expr("IF(doc_id = 6, NULL, sections)"))
    assert tokencounts.attribute(null, "document", PATH, "sections").where("doc_id = 6").count() == 0


def test_round_trip_is_encode_and_decode_in_one_pass(spark):
    docs = spark.createDataFrame([(1, "Ünï  code\n\n12"), (2, None), (3, ""), (4, "a" * 5000 + " 're <|endoftext|>")], "doc_id long, text string")
    once = bpe.round_trip(docs, "text", PATH).select("doc_id", "tokens.*")
    encoded = bpe.encode(docs, "text", PATH).select("doc_id", "tokens.*")
    twice = bpe.decode(encoded, "token_ids", PATH)
    assert once.orderBy("doc_id").collect() == twice.orderBy("doc_id").collect()


def test_stage_of_tokens_has_one_python_pass(spark):
    from hexcadence.llm.workload import tokens_and_text

    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    plan = tokens_and_text(docs, PATH, ids=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
