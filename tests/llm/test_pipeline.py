"""The pipeline, stage by stage, against brute force; and on hard rows."""

import hashlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from hexcadence.llm import pii, quality
from hexcadence.llm.base import stored
from hexcadence.llm.workload import vocabulary
from tests.llm.frames import empty_docs, hard_docs
from tests.llm.test_documents import WORDS, plain_counts, plain_spans, plain_targets
from tests.llm.test_pairs import components, plain_fingerprint

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def results(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), "stage")
        out[name] = docs
    return out


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_stages_keep_the_columns(results):
    for name in list(results)[:-1]:
        assert results[name].dtypes == results["documents"].dtypes


def test_quality_stage(spark, results):
    rules = quality.Rules()
    refs = quality.references(results["documents"], "text", "lang", rules)
    want = [r for r in rows(results["documents"]) if quality.judge(r["text"], r["lang"], refs, rules)[-1]]
    assert sorted(rows(results["quality"]), key=str) == sorted(want, key=str)
    assert not any(plain_counts(r["text"])[5] for r in want)
    labels = {r["doc_id"]: r["quality"] for r in rows(spark.read.parquet(f"{SF}/labels.parquet"))}
    kept = {r["doc_id"] for r in want}
    clean = [r["doc_id"] for r in rows(results["documents"]) if labels.get(r["doc_id"]) == 1 and not plain_counts(r["text"])[5]]
    assert np.mean([d in kept for d in clean]) > 0.99


def test_duplicate_stage(results):
    docs = sorted(rows(results["quality"]), key=lambda r: r["doc_id"])
    fps = [plain_fingerprint(r["text"]) for r in docs]
    roots = components(len(docs), [(i, j) for i, j in combinations(range(len(docs)), 2) if (fps[i] ^ fps[j]).bit_count() <= 4])
    want = [r for i, r in enumerate(docs) if roots[i] == i]
    assert sorted(rows(results["near duplicates"]), key=str) == sorted(want, key=str)


def test_personal_data_stage(results):
    want = []
    for r in rows(results["near duplicates"]):
        text = pii.redact(r["text"], plain_spans(r["text"]))
        want.append(r | {"text": text, "n_chars": len(text)})
    assert sorted(rows(results["personal data"]), key=str) == sorted(want, key=str)
    assert any("[EMAIL]" in r["text"] for r in want)


def test_mix_stage(results):
    before, after = rows(results["personal data"]), rows(results["mix"])
    size = lambda r: len(WORDS.findall(r["text"]))
    sizes, taken = Counter(), Counter()
    for r in before:
        sizes[r["source"]] += size(r)
    for r in after:
        taken[r["source"]] += size(r)
    target = plain_targets(sizes)
    assert all(abs(taken[s] - target[s]) <= 0.1 * target[s] for s in target)
    times = Counter(map(str, after))
    assert set(times) <= set(map(str, before)) and max(times.values()) <= 3


def test_token_stage(results):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary())
    want = []
    for r in rows(results["mix"]):
        packed = np.array(library.encode(r["text"], add_special_tokens=False).ids, "<u4").tobytes()
        digests = [hashlib.sha256(x).hexdigest() for x in (packed, r["text"].encode())]
        want.append((r["doc_id"], r["source"], r["lang"], len(packed) // 4, packed, *digests))
    got = [tuple(bytes(x) if isinstance(x, bytearray) else x for x in r.values()) for r in rows(results["tokens"])]
    assert sorted(got) == sorted(want)


def test_run_gives_the_last_stage(spark, results):
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(str, got.collect())) == sorted(map(str, results["tokens"].collect()))


@pytest.mark.parametrize("name", [n for n in STAGES if n != "tokens"])
def test_stages_on_hard_rows(spark, name):
    docs = hard_docs(spark)
    out = STAGES[name](spark, docs, SF)
    assert out.dtypes == docs.dtypes
    got = out.collect()
    if name == "quality":
        assert all(not plain_counts(r["text"])[5] for r in got)
    elif name == "near duplicates":
        ids = [r["doc_id"] for r in got]
        assert ids.count(1) == 1 and 9 in ids and 10 not in ids and 3 in ids and 4 not in ids
    elif name == "personal data":
        assert len(got) == 13
    assert STAGES[name](spark, empty_docs(spark), SF).count() == 0


def test_token_stage_on_hard_rows(spark):
    assert STAGES["tokens"](spark, hard_docs(spark), SF).count() == 13
    assert STAGES["tokens"](spark, empty_docs(spark), SF).count() == 0
