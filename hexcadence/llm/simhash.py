"""SimHash fingerprints, and all pairs of near fingerprints by anchor points of a covering code."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hexcadence.llm.base import free_names, map_rows, named, stored
from hexcadence.llm.components import local_roots, star_roots

BITS = 64
CODE_BITS = 15  #: the part of a block that the perfect code of radius 1 covers
CHUNK = 2048  #: fingerprints of one anchor that a task compares with as many others
_PAIRS = 1 << 20  #: comparisons made at once
_SHINGLES = 1 << 16  #: hashes whose bits are counted at once


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of a text's word shingles (XXH64), as an unsigned integer.

    A-Z are lower-cased; words are runs of anything but ASCII white space; a text of fewer words is one shingle; a
    text without words, or null, has fingerprint 0. A bit is set if it is set in more than half of the hashes.
    """
    from xxhash import xxh64_intdigest

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes split at ASCII white space alone
    if not parts:
        return 0
    line = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    k = min(words, len(parts))
    spans = list(zip(starts[: len(parts) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True))
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(spans), _SHINGLES):
        hashes = np.array([xxh64_intdigest(line[a:b], seed) for a, b in spans[i : i + _SHINGLES]], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(spans), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str, into: str = "fingerprint", keep: list[str] | None = None) -> DataFrame:
    """Add the fingerprint of ``text`` as a long (the 64 bits, signed); rows stay where they are."""

    def make():
        return lambda texts: pa.array(
            np.fromiter(map(fingerprint, texts), np.uint64, len(texts)).view(np.int64), pa.int64()
        )

    return map_rows(df, [text], into, T.LongType(), make, keep)


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# --- anchors --------------------------------------------------------------------------------------
#
# Fingerprints within ``distance`` of each other differ by at most distance // n_blocks bits in one of n_blocks
# parts. In that part, anchors are the words of a covering code of radius 1: on 15 bits the perfect Hamming code,
# on the other bits every value. A fingerprint's home is the anchor within radius 1; the other fingerprint of a pair
# then lies within 1 + distance // n_blocks of that anchor. So every fingerprint is sent to all anchors within
# that distance of it, and each home is compared with all visitors of its anchor.


def blocks(n: int) -> list[tuple[int, int]]:
    """(shift, width) of n parts of the 64 bits."""
    cuts = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _syndrome(e: int) -> int:
    s = 0
    for i in range(CODE_BITS):
        if e >> i & 1:
            s ^= i + 1
    return s


def _steps(width: int, radius: int) -> list[list[int]]:
    """For each syndrome, the flips of at most ``radius`` bits that lead from a value with it to an anchor, home first."""
    from itertools import combinations

    out: list[list[int]] = [[] for _ in range(CODE_BITS + 1)]
    for k in range(radius + 1):
        for bits in combinations(range(width), k):
            e = sum(1 << b for b in bits)
            out[_syndrome(e & (1 << CODE_BITS) - 1)].append(e)
    return out


def _anchor(block: int, value: Column):
    return lambda flips, i: F.struct(
        F.lit(block).cast("tinyint").alias("block"), value.bitwiseXOR(flips).alias("anchor"), (i == 0).alias("home")
    )


def _sent(fps: DataFrame, fp: str, distance: int, n_blocks: int) -> DataFrame:
    """Rows (block, anchor, fp, home) for every anchor that a fingerprint is sent to."""
    each = []
    for k, (shift, width) in enumerate(blocks(n_blocks)):
        steps = _steps(width, 1 + distance // n_blocks)
        value = F.shiftrightunsigned(F.col(fp), shift).bitwiseAND(F.lit((1 << width) - 1))
        # The syndrome's four bits are parities of the positions (from 1) that have that bit.
        checks = [sum(1 << i for i in range(CODE_BITS) if i + 1 >> bit & 1) for bit in range(4)]
        syndrome = sum(
            (F.bit_count(value.bitwiseAND(F.lit(m))) % 2 * (1 << bit) for bit, m in enumerate(checks)), F.lit(0)
        )
        table = F.array(*[F.array(*[F.lit(e).cast("bigint") for e in row]) for row in steps])
        each.append(F.transform(F.element_at(table, syndrome.cast("int") + 1), _anchor(k, value)))
    return fps.select(F.col(fp), F.explode(F.concat(*each)).alias("at")).select("at.*", fp)


def _compare(distance: int):
    """Edges among homes and visitors of anchors: each node of a local component but the least, with the least."""

    def run(batches):
        for batch in batches:
            homes, visitors = batch.column(0), batch.column(1)
            ho, vo = homes.offsets.to_numpy(), visitors.offsets.to_numpy()
            h_all = homes.values.to_numpy(zero_copy_only=False)
            v_all = visitors.values.to_numpy(zero_copy_only=False)
            nh, nv = np.diff(ho), np.diff(vo)
            cost = np.cumsum(nh.astype(np.int64) * nv)
            found_a, found_b, i = [], [], 0
            while i < len(nh):
                j = max(i + 1, int(np.searchsorted(cost, (cost[i - 1] if i else 0) + _PAIRS, side="right")))
                n = nh[i:j].astype(np.int64) * nv[i:j]
                row = np.repeat(np.arange(i, j), n)
                within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                a = h_all[ho[row] + within // np.maximum(nv[row], 1)]
                b = v_all[vo[row] + within % np.maximum(nv[row], 1)]
                near = np.bitwise_count((a ^ b).view(np.uint64)) <= distance
                near &= a != b
                if near.any():
                    node, root = local_roots(a[near], b[near])
                    found_a.append(node)
                    found_b.append(root)
                i = j
            if found_a:
                node, root = local_roots(np.concatenate(found_a), np.concatenate(found_b))
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["node", "root"])

    return run


def near_edges(fps: DataFrame, fp: str, distance: int = 4, n_blocks: int = 3, chunk: int = CHUNK) -> DataFrame:
    """Edges (node, root) that connect exactly the fingerprints linked by chains of pairs within ``distance`` bits.

    ``fps`` holds distinct fingerprints. Every near pair meets at an anchor and is compared there. A batch of
    anchors gives one edge for each node but the least of what it connects, never all pairs of a group. An anchor
    with more than ``chunk`` visitors is dealt out in squares of homes by visitors, each of about chunk by chunk.
    """
    sent = stored(_sent(fps, fp, distance, n_blocks), "anchors")
    # Only anchors beyond the chunk size; the planner broadcasts them if the written file is small enough.
    hot = stored(
        sent.groupBy("block", "anchor")
        .agg(F.count(F.lit(1)).alias("visitors"), F.count_if("home").alias("homes"))
        .where(F.col("visitors") > chunk)
        .select(
            "block",
            "anchor",
            F.ceil(F.col("visitors") / chunk).cast("int").alias("nv"),
            F.greatest(F.lit(1), F.ceil(F.col("homes") / chunk)).cast("int").alias("nh"),
        ),
        "hot",
    )
    dealt = sent.join(hot, ["block", "anchor"], "left")
    one = F.array(F.lit(0))
    nv, nh = F.coalesce("nv", F.lit(1)), F.coalesce("nh", F.lit(1))
    place = F.xxhash64(fp, F.lit(7))
    as_home = F.transform(
        F.when(nv > 1, F.sequence(F.lit(0), nv - 1)).otherwise(one),
        lambda v: F.struct(F.pmod(place, nh).cast("int").alias("h"), v.alias("v"), F.lit(True).alias("as_home")),
    )
    as_visitor = F.transform(
        F.when(nh > 1, F.sequence(F.lit(0), nh - 1)).otherwise(one),
        lambda h: F.struct(h.alias("h"), F.pmod(place, nv).cast("int").alias("v"), F.lit(False).alias("as_home")),
    )
    squares = dealt.select(
        "block", "anchor", fp, F.col("nv").isNotNull().alias("dealt"), F.explode(F.when(F.col("home"), F.concat(as_home, as_visitor)).otherwise(as_visitor)).alias("to")
    )
    met = (
        squares.groupBy("block", "anchor", "to.h", "to.v")
        .agg(
            F.collect_list(F.when(F.col("to.as_home"), F.col(fp))).alias("homes"),
            F.collect_list(F.when(~F.col("to.as_home"), F.col(fp))).alias("visitors"),
            F.max("dealt").alias("dealt"),
        )
        # The only visitor of an anchor is its home; the only one of a square may be another fingerprint.
        .where((F.size("homes") > 0) & ((F.size("visitors") > 1) | F.col("dealt")))
    )
    return met.select("homes", "visitors").mapInArrow(_compare(distance), "node bigint, root bigint")


def near_components(df: DataFrame, id_col: str, text: str, distance: int = 4) -> DataFrame:
    """Rows (id, fingerprint, component): near-duplicate classes of all rows by SimHash.

    Rows whose fingerprints are within ``distance`` bits are linked, equal ones included; ``component_id`` is the
    smallest id reachable (null only if all ids there are null). Texts without words have fingerprint 0 and link
    like any other. Copies are one node, so a group of copies of any size costs one fingerprint. Repeated rows each
    give a row. The result has the columns ``id_col``, fingerprint (long) and component_id; other input columns are
    not read.
    """
    fp, comp = free_names(df.select(named(id_col)), "fingerprint", "component_id")
    rows = stored(
        fingerprints(df.select(named(id_col), named(text).alias(free_names(df, "body")[0])), free_names(df, "body")[0], fp, [id_col]),
        "fingerprints",
    )
    classes = stored(rows.groupBy(fp).agg(F.min(named(id_col)).alias("least")), "classes")
    roots = star_roots(near_edges(classes.select(fp), fp, distance))
    linked = stored(
        classes.join(roots, classes[fp] == roots["node"], "left").select(
            fp, "least", F.coalesce("root", fp).alias("root")
        ),
        "linked",
    )
    least = linked.groupBy("root").agg(F.min("least").alias(comp))
    of_class = linked.join(least, "root").select(F.col(fp), F.col(comp))
    return rows.join(of_class, fp).select(named(id_col), fp, comp)
