"""Near pairs of fingerprints and of vectors against brute force."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from hexcadence.llm import covertree, simhash
from hexcadence.llm.components import local_roots, star_roots
from hexcadence.llm.workload import op4_cover_tree, op10_simhash
from tests.llm.frames import empty_docs, hard_docs, prose

SF = "/root/testdata/sf0.001"


def components(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_local_and_star_roots(spark):
    r = random.Random(4)
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 400)]
    mixed = [(r.randrange(2000, 2400), r.randrange(2000, 2400)) for _ in range(260)]
    edges = [*chain, *star, *mixed, (5, 5), (7, 6), (7, 6)]
    r.shuffle(edges)
    want = components(2400, edges)
    got = dict(zip(*[x.tolist() for x in local_roots(*map(np.array, zip(*edges, strict=True)))], strict=True))
    assert [got.get(i, i) for i in range(2400)] == want
    df = spark.createDataFrame([*edges, (None, 3)], "node bigint, root bigint")
    got = {x["node"]: x["root"] for x in star_roots(df).collect()}
    assert [got.get(i, i) for i in range(2400)] == want
    assert star_roots(df.limit(0)).count() == 0


# --- fingerprints -----------------------------------------------------------------------------------


def plain_fingerprint(text):
    import re

    from xxhash import xxh64

    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(simhash, "_SHINGLES", 7)
    for text in (None, "", " ", "One", "A b c", "É x Y z", prose(1, 4), prose(2, 5), prose(3, 200).upper(), "a a a a a a"):
        assert simhash.fingerprint(text) == plain_fingerprint(text)
    # The JVM's xxhash64 is the same function.
    df = spark.createDataFrame([("a b c d",), ("é 漢 x y",)], "t string").select("t", F.xxhash64("t").alias("h"))
    assert all(simhash.fingerprint(r["t"]) == r["h"] % (1 << 64) for r in df.collect())


@pytest.mark.parametrize(("distance", "n_blocks", "chunk"), [(4, 3, 2048), (4, 3, 3), (3, 2, 5), (5, 3, 2048)])
def test_all_near_fingerprints_are_connected(spark, distance, n_blocks, chunk):
    r = random.Random(distance * 10 + chunk)
    fps = {r.getrandbits(64) for _ in range(40)}
    for f in list(fps):
        for _ in range(r.choice([0, 1, 6])):
            g = f
            for b in r.sample(range(64), r.randint(1, distance + 2)):
                g ^= 1 << b
            fps.add(g)
    near = r.getrandbits(64)
    fps |= {near ^ 1 << a ^ 1 << b for a, b in combinations(range(12), 2)} | {0, (1 << 64) - 1}
    fps = sorted(fps)
    pairs = [(i, j) for i, j in combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= distance]
    want = components(len(fps), pairs)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    edges = simhash.near_edges(df, "fp", distance, n_blocks, chunk).collect()
    place = {f: i for i, f in enumerate(signed)}
    assert all((signed.index(e["node"]) != signed.index(e["root"])) for e in edges)
    assert components(len(fps), [(place[e["node"]], place[e["root"]]) for e in edges]) == want


def test_squares_with_one_visitor_are_compared(spark):
    """Pairs far from each other, one link each: every square of a dealt anchor counts."""
    r = random.Random(12)
    fps = [x for _ in range(60) for a in [r.getrandbits(64)] for x in (a, a ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 4))))]
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    edges = {frozenset(e) for e in simhash.near_edges(df, "fp", chunk=1).collect()}
    assert edges == {frozenset(signed[i : i + 2]) for i in range(0, 120, 2)}


def test_simhash_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    fps = [plain_fingerprint(d["text"]) for d in docs]
    pairs = [(i, j) for i, j in combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= 4]
    roots = components(len(fps), pairs)
    least = {}
    for d, root in zip(docs, roots, strict=True):
        least[root] = min(least.get(root, d["doc_id"]), d["doc_id"])
    want = {(d["doc_id"], f"{f:016x}", least[root]) for d, f, root in zip(docs, fps, roots, strict=True)}
    assert {tuple(r) for r in op10_simhash(spark, SF).collect()} == want


def test_simhash_hard_rows(spark):
    got = simhash.near_components(hard_docs(spark), "doc_id", "text").collect()
    assert len(got) == 13
    by = {r["doc_id"]: r["component_id"] for r in got}
    assert by[4] == by[5] == by[3] == 3 and by[10] == 9 and by[1] == 1
    assert sum(r["doc_id"] is None for r in got) == 2
    assert {r["component_id"] for r in got if r["doc_id"] is None} == {None, 3}
    assert simhash.near_components(empty_docs(spark), "doc_id", "text").count() == 0


# --- vectors ----------------------------------------------------------------------------------------


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize(
    ("n", "dims", "centers", "spread", "threshold"),
    [(300, 8, 5, 0.1, 0.9), (500, 3, 500, 0.0, 0.9), (400, 2, 400, 0.0, 0.99), (600, 16, 3, 0.05, 0.9), (300, 64, 30, 0.2, 0.9), (60, 4, 1, 0.0, 0.9), (500, 5, 20, 0.3, 0.5)],
)
def test_dual_traversal_equals_brute_force(n, dims, centers, spread, threshold):
    rng = np.random.default_rng(n)
    c = rng.normal(size=(centers, dims))
    x = unit(c[rng.integers(0, centers, n)] + spread * rng.normal(size=(n, dims)))
    for left, right in ((x, None), (x[: n // 3], x[n // 3 :])):
        a, at = covertree.Tree.build(left)
        b, bt = (None, None) if right is None else covertree.Tree.build(right)
        links, (u, v) = covertree.near_pairs(a, b, threshold)
        rows = left[at] if right is None else np.concatenate([left[at], right[bt]])
        near = rows @ rows.T >= threshold
        np.fill_diagonal(near, False)
        if right is not None:
            near[: len(left), : len(left)] = near[len(left) :, len(left) :] = False
        assert (links == near.sum(1)).all()
        node, root = local_roots(u, v)
        label = np.arange(max(n, u.max(initial=0) + 1, v.max(initial=0) + 1))
        label[node] = root
        want = np.array(components(n, np.argwhere(near)))
        linked = np.flatnonzero(links)
        assert len(set(zip(label[linked], want[linked], strict=True))) == len(set(label[linked])) == len(set(want[linked]))


def test_levels_halve_and_cover():
    x = unit(np.random.default_rng(1).normal(size=(400, 4)))
    tree, _ = covertree.Tree.build(x)
    for k in range(len(tree.center)):
        inside = tree.x[tree.start[k] : tree.end[k]]
        far = np.linalg.norm(inside - tree.x[tree.center[k]], axis=1).max()
        assert far <= tree.radius[k] + 1e-7 and tree.start[k] <= tree.center[k] < tree.end[k]
        if tree.children[k]:
            kids = slice(tree.child[k], tree.child[k] + tree.children[k])
            assert tree.center[k] in tree.center[kids] and tree.size[kids].sum() == tree.size[k]


def brute_vectors(rows):
    x = {}
    for i, (_, v) in enumerate(rows):
        if v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v):
            x[i] = np.array(v, float)
    pairs = [(i, j) for i, j in combinations(x, 2) if len(x[i]) == len(x[j]) and x[i] @ x[j] / np.linalg.norm(x[i]) / np.linalg.norm(x[j]) >= 0.9]
    roots = components(len(rows), pairs)
    out = []
    for i, (k, _) in enumerate(rows):
        least = min((rows[j][0] for j in range(len(rows)) if roots[j] == roots[i] and rows[j][0] is not None), default=None)
        out.append((k, sum(i in p for p in pairs), least, k == least))
    return sorted(out, key=str)


def test_vectors_hard_rows(spark):
    r = np.random.default_rng(2)
    base = r.normal(size=(6, 5))
    rows = [(i, (base[i % 6] + 0.2 * r.normal(size=5)).tolist()) for i in range(40)]
    rows += [(50, None), (51, []), (52, [0.0] * 5), (53, [1.0, None, 0.0, 0.0, 0.0]), (54, [float("nan"), 1.0, 0.0, 0.0, 0.0]), (55, [float("inf"), 1.0, 0.0, 0.0, 0.0]), (56, [1.0, 2.0]), (57, [2.0, 4.0]), (3, rows[3][1]), (None, rows[4][1]), (60, [1e300, 0, 0, 0, 1e300]), (61, [1e-300, 0, 0, 0, 1e-300])]
    rows = [(k, None if v is None else [None if c is None else float(c) for c in v]) for k, v in rows]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumns({c: F.lit(1) for c in ("uid", "cell", "part", "n_links", "vec")})
    want = brute_vectors([(k, None if v is None else [c if c is None else c / 1e300 if abs(c) > 1e200 else c * 1e300 if 0 < abs(c) < 1e-200 else c for c in v]) for k, v in rows])
    for block in (4096, 7):
        got = covertree.near_components(df, "vec_id", "embedding", 0.9, block).collect()
        assert sorted(map(tuple, got), key=str) == want
    assert covertree.near_components(df.limit(0), "vec_id", "embedding").count() == 0
    nothing = covertree.near_components(df.where("vec_id BETWEEN 50 AND 55"), "vec_id", "embedding").collect()
    assert all(r["n_links"] == 0 and r["kept"] for r in nothing) and len(nothing) == 6


def test_vector_query_links(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(map(tuple, op4_cover_tree(spark, SF).collect()), key=str) == brute_vectors(rows)
