"""Fingerprints of documents from prefix polynomial hashes.

The prefix array of a text holds P[i] = sum of c[j] * B^j over j < i, modulo a prime, for two bases. The difference of two
entries is a span's hash up to a power of the base, so any two spans, of one text or of two, are compared by one
multiplication each, and the longest common extension of two places is found by binary search.

A fingerprint keeps that array at chosen places only: those after the windows with the smallest hashes, a choice that
follows the content and not the position. Spans between kept places are still comparable, within a fingerprint and
between two. Of two fingerprints the one that keeps windows up to a larger hash is thinned to the other's limit; then both
have kept the same places wherever their texts are alike. Runs of equal spans are extended by binary search, from the
starts of the texts, from their ends, and from every span that both have; their share of both texts is the likeness.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hexcadence.llm.base import named, small_batches

PRIME = (1 << 31) - 1
BASES = (1_103_515_245, 1_664_525)  #: two odd multipliers; their pairs of hashes have 62 bits
WINDOW = 12  #: code points of a window
PLACES = 32  #: kept places of a fingerprint
SAMPLE = 8  #: keys that are looked at for every range of documents
SLICE = 1 << 18  #: code points that are hashed at once
_ALL = (1 << 32) - 1  #: the limit of a fingerprint that keeps every place
_WINDOWS = _ALL - 1  #: the limit of one that keeps every different window
_INVERSE = tuple(pow(b, -1, PRIME) for b in BASES)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * np.uint64(pow(base, have, PRIME)) % np.uint64(PRIME)
        have += more
    return out


class _Tables:
    """Powers of the bases and of their inverses, as long as a slice asks for."""

    def __init__(self):
        self.n = 0

    def get(self, n: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        if n > self.n:
            self.n = 1 << (n - 1).bit_length()
            self.up = [_powers(b, self.n) for b in BASES]
            self.down = [_powers(b, self.n) for b in _INVERSE]
        return self.up, self.down


_TABLES = _Tables()


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


class Prefix:
    """The whole prefix array of a text: equality of any spans, and longest common extensions."""

    def __init__(self, text: str):
        self.n = len(text)
        up, _ = _TABLES.get(self.n + 1)
        c = code_points(text) + np.uint64(1)
        self.sums = []
        for powers in up:
            total = np.zeros(self.n + 1, np.uint64)
            np.cumsum(c * powers[: self.n] % np.uint64(PRIME), out=total[1:])
            self.sums.append((total % np.uint64(PRIME)).astype(np.int64))

    def span(self, start: int, end: int) -> tuple[int, ...]:
        """The hash of a span, the same wherever it stands."""
        return tuple((int(p[end]) - int(p[start])) * pow(inv, start, PRIME) % PRIME for p, inv in zip(self.sums, _INVERSE, strict=True))

    def equal(self, start: int, other: Prefix, at: int, length: int) -> bool:
        """Whether text[start:start+length] equals the other's [at:at+length]; spans beyond an end are not equal."""
        if length < 0 or min(start, at) < 0 or start + length > self.n or at + length > other.n:
            return False
        for p, q, base in zip(self.sums, other.sums, BASES, strict=True):
            a = (int(p[start + length]) - int(p[start])) * pow(base, at, PRIME)
            b = (int(q[at + length]) - int(q[at])) * pow(base, start, PRIME)
            if (a - b) % PRIME:
                return False
        return True

    def extension(self, start: int, other: Prefix, at: int) -> int:
        """The length of the longest common extension to the right of two places."""
        return _longest(min(self.n - start, other.n - at), lambda m: self.equal(start, other, at, m))

    def extension_back(self, end: int, other: Prefix, at: int) -> int:
        """The length of the longest common extension to the left of two places."""
        return _longest(min(end, at), lambda m: self.equal(end - m, other, at - m, m))


def _longest(most: int, holds) -> int:
    """The largest m <= most for which ``holds`` is true, where it is true up to some m and false beyond."""
    low, high = 0, most
    while low < high:
        middle = (low + high + 1) // 2
        if holds(middle):
            low = middle
        else:
            high = middle - 1
    return low


# --- fingerprints ---------------------------------------------------------------------------------


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """32 well-spread bits of a window's two hashes."""
    x = (a << np.uint64(31)) | b
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(32))) & np.uint64(_ALL)


class Fingerprint:
    """Kept places of a text with the prefix hashes there; places 0 and n are always among them.

    Of every different window only the first occurrence counts. A text of fewer than WINDOW + PLACES code points keeps
    all its places.
    """

    def __init__(self, n: int, limit: int, at: list[int], strength: list[int], hashes: list[tuple[int, int]]):
        self.n, self.limit, self.at, self.strength, self.hashes = n, limit, at, strength, hashes

    @staticmethod
    def of(text: str) -> Fingerprint:
        """Read slice by slice; memory follows the slice and not the text."""
        n = len(text)
        size = min(SLICE, n)
        up, down = _TABLES.get(size + WINDOW + 1)
        p = np.uint64(PRIME)
        best: dict[int, tuple[int, tuple[int, int]]] = {}  # window hash -> first place after it, prefix hashes there
        limit, base = _WINDOWS, [0, 0]
        short: list[tuple[int, int, tuple[int, int]]] = []
        for s in range(0, n, SLICE):
            back = min(WINDOW - 1, s)  # windows that begin before the slice
            c = code_points(text[s - back : s + SLICE]) + np.uint64(1)
            m = len(c)
            sums, windows = [], []
            for powers, inverse in zip(up, down, strict=True):
                total = np.zeros(m + 1, np.uint64)
                np.cumsum(c * powers[:m] % p, out=total[1:])
                total %= p
                sums.append(total)
                if m >= WINDOW:
                    windows.append((total[WINDOW:] + p - total[:-WINDOW]) % p * inverse[: m + 1 - WINDOW] % p)
            # Prefix hashes of the whole text: what lies before, plus this slice moved to its place.
            moved = [pow(b, s - back, PRIME) for b in BASES]
            before = [(base[i] - int(sums[i][back]) * moved[i]) % PRIME for i in (0, 1)]
            if m >= WINDOW:
                strength = np.minimum(_mixed(*windows), np.uint64(_WINDOWS))
                keep = np.flatnonzero(strength <= np.uint64(limit))
                values, first = np.unique(strength[keep], return_index=True)
                first = keep[first]
                for v, f in zip(values[: PLACES + 1].tolist(), first[: PLACES + 1].tolist(), strict=True):
                    if v not in best:
                        i = f + WINDOW
                        best[v] = (s - back + i, tuple((before[b] + int(sums[b][i]) * moved[b]) % PRIME for b in (0, 1)))
                if len(best) > PLACES:
                    kept = sorted(best)[:PLACES]
                    best, limit = {v: best[v] for v in kept}, kept[-1]
            base = [(before[b] + int(sums[b][m]) * moved[b]) % PRIME for b in (0, 1)]
            if n < WINDOW + PLACES:
                here = range(back + 1, m + 1)
                short += [(s - back + i, _ALL, tuple((before[b] + int(sums[b][i]) * moved[b]) % PRIME for b in (0, 1))) for i in here]
        places = [(i, v, h) for v, (i, h) in best.items() if i < n]
        if n < WINDOW + PLACES:
            limit, own = _ALL, {i for i, _, _ in places}
            places += [x for x in short if x[0] not in own and x[0] < n]
        places.sort()
        at = [0, *(i for i, _, _ in places), n]
        hashes = [(0, 0), *(h for _, _, h in places), (base[0], base[1])]
        return Fingerprint(n, limit, at, [0, *(v for _, v, _ in places), 0], hashes)

    def packed(self) -> str:
        """Text form: length and limit, then place, window hash and prefix hashes of every kept place."""
        head = np.array([self.n, self.limit], "<u8").tobytes()
        rows = np.zeros(len(self.at) - 1, [("at", "<u8"), ("strength", "<u4"), ("a", "<u4"), ("b", "<u4")])
        rows["at"], rows["strength"] = self.at[1:], self.strength[1:]
        rows["a"], rows["b"] = [h[0] for h in self.hashes[1:]], [h[1] for h in self.hashes[1:]]
        return base64.b64encode(head + rows.tobytes()).decode()

    @staticmethod
    def unpacked(value: str) -> Fingerprint:
        raw = base64.b64decode(value)
        n, limit = (int(x) for x in np.frombuffer(raw[:16], "<u8"))
        rows = np.frombuffer(raw[16:], [("at", "<u8"), ("strength", "<u4"), ("a", "<u4"), ("b", "<u4")])
        hashes = [(0, 0), *zip(rows["a"].tolist(), rows["b"].tolist(), strict=True)]
        return Fingerprint(n, limit, [0, *rows["at"].tolist()], [0, *rows["strength"].tolist()], hashes)

    def thinned(self, limit: int) -> Fingerprint:
        """Only places of windows up to a limit, and the two ends."""
        if limit >= self.limit:
            return self
        keep = [i for i, v in enumerate(self.strength) if v <= limit or i == 0 or i == len(self.at) - 1]
        return Fingerprint(self.n, limit, *[[x[i] for i in keep] for x in (self.at, self.strength, self.hashes)])

    def span(self, i: int, j: int) -> tuple[int, int, int]:
        """Length and hash of the span between two kept places."""
        start = self.at[i]
        a, b = ((self.hashes[j][k] - self.hashes[i][k]) * pow(_INVERSE[k], start, PRIME) % PRIME for k in (0, 1))
        return self.at[j] - start, a, b


def likeness(x: Fingerprint, y: Fingerprint) -> float:
    """Share of both texts in runs of equal spans: 1 for equal texts (two empty ones too), 0 if nothing is shared.

    It is measured at kept places: text between the last common place and a difference doesn't count, which costs about
    one span a difference. A text that repeats itself has places in its first round only, so one round more or less
    leaves little that is known to be equal.
    """
    if (x.n, x.hashes[-1]) == (y.n, y.hashes[-1]):
        return 1.0
    if not x.n or not y.n:
        return 0.0
    limit = min(x.limit, y.limit)
    x, y = x.thinned(limit), y.thinned(limit)
    nx, ny = len(x.at) - 1, len(y.at) - 1
    head = _longest(min(nx, ny), lambda m: x.at[m] == y.at[m] and x.hashes[m] == y.hashes[m])
    tail = _longest(min(nx, ny) - head, lambda m: x.span(nx - m, nx) == y.span(ny - m, ny))
    shared = x.at[head] + x.n - x.at[nx - tail]
    spans: dict[tuple, list[int]] = {}
    for j in range(head, ny - tail):
        spans.setdefault(y.span(j, j + 1), []).append(j)
    used: set[int] = set()
    i = head
    while i < nx - tail:
        at = next((j for j in spans.get(x.span(i, i + 1), ()) if j not in used), None)
        if at is None:
            i += 1
            continue
        most = min(nx - tail - i, ny - tail - at)
        run = _longest(most, lambda m: x.span(i, i + m) == y.span(at, at + m))  # noqa: B023
        run = next((m for m in range(1, run) if at + m in used), run)
        if x.at[i + run] - x.at[i] >= WINDOW:
            shared += x.at[i + run] - x.at[i]
            used.update(range(at, at + run))
        i += run
    return 2 * shared / (x.n + y.n)


# --- in Spark -------------------------------------------------------------------------------------


def edited(text: str, other: str, share: int = 4) -> str:
    """The last floor(n / share) code points replaced by the first as many (or all) of another text."""
    k = len(text) // share
    return text[: len(text) - k] + other[:k]


def _cuts(keys: DataFrame, parts: int) -> tuple[list, object]:
    """At most ``parts`` - 1 keys that occur and lie evenly, and the smallest key.

    A sample by the keys' hashes, about SAMPLE for each part, reaches the driver.
    """
    first = keys.agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("least")).first()
    step = max(1, first["n"] // (SAMPLE * parts))
    at = [r["key"] for r in keys.where(F.pmod(F.xxhash64("key"), F.lit(step)) == 0).distinct().orderBy("key").collect()]
    places = sorted({i * len(at) // parts for i in range(1, parts)}) if at else []
    return [at[i] for i in places if at[i] != first["least"]], first["least"]


def with_next(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """Rows (id, text, part, follows) sorted by (part, follows, key): every row once, and after the rows of each part,
    marked by ``follows``, the first row of the part behind it (behind the last, of the first).

    Parts are ranges of (id, hash of the text), nulls last, between keys that occur; so each part's first row is known
    by its key, and texts are shuffled once.
    """
    spark = df.sparkSession
    body = F.coalesce(named(text), F.lit(""))
    key = F.struct(named(id_col).isNull().alias("none"), named(id_col).alias("id"), F.xxhash64(body).alias("h"))
    rows = df.select(named(id_col).alias("id"), body.alias("text"), key.alias("key"))
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts, least = _cuts(rows.select("key"), parts)
    last = len(cuts)
    kind = rows.schema["key"].dataType
    # Two levels, so that a row is compared with about twice the root of the number of cuts.
    wide = int(last**0.5) + 1
    groups = [cuts[i : i + wide] for i in range(0, last, wide)] or [[]]
    told = T.StructType([T.StructField("groups", T.ArrayType(T.ArrayType(kind))), T.StructField("least", kind)])
    known = spark.createDataFrame([(groups, least)], told)
    rows = rows.withColumns({"groups": known.select("groups").scalar(), "start": known.select("least").scalar()})
    group = F.size(F.filter("groups", lambda g: F.try_element_at(g, F.lit(1)) <= F.col("key")))
    inside = F.filter(F.element_at("groups", F.greatest(group, F.lit(1))), lambda c: c <= F.col("key"))
    rows = rows.withColumn("part", F.when(group == 0, 0).otherwise((group - 1) * wide + F.size(inside)))
    cut = F.exists("groups", lambda g: F.array_contains(g, F.col("key")))
    own = F.struct(F.col("part").alias("part"), F.lit(0).alias("follows"))
    before = F.struct((F.col("part") - 1).alias("part"), F.lit(1).alias("follows"))
    end = F.struct(F.lit(last).alias("part"), F.lit(1).alias("follows"))
    places = F.when(F.col("key") == F.col("start"), F.array(own, end)).when(cut, F.array(own, before)).otherwise(F.array(own))
    return (
        rows.select("id", "text", "key", F.explode(places).alias("place"))
        .select("id", "text", "key", "place.part", "place.follows")
        .repartition("part").sortWithinPartitions("part", "follows", "key").select("id", "text", "part", "follows")
    )


def _told(texts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row as soon as the one behind it is known; one text and its fingerprint are held."""
    held = None
    for batch in texts:
        out: list[tuple] = []
        for key, text, part, follows in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if follows and held is None:
                continue  # the part behind has several rows of its first key
            own = Fingerprint.of(text)
            if held is not None:
                out.append(_row(*held, text, own))
            held = None if follows else (key, text, own)
        if out:
            columns = list(zip(*out, strict=True))
            kinds = (batch.schema.field(0).type, pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=_OUT)


_OUT = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _row(key, text: str, own: Fingerprint, after: str, after_print: Fingerprint) -> tuple:
    new = edited(text, after)
    other = own if new == text else Fingerprint.of(new)
    digest = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
    return key, len(text), digest, own.packed(), other.packed(), likeness(own, other), likeness(own, after_print)


def compared(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """Rows (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row of ``df``.

    The next document is that of the next id in ascending order, after the last the first; null ids come last, and rows
    of one id follow each other by the hash of their texts. A null text is an empty one. A single row is its own next.
    Two empty texts are alike (1.0), an empty and another one not (0.0). An empty table gives no rows. Only ``id_col``
    and ``text`` are read, whatever other columns are called.
    """
    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(df, id_col, text).mapInArrow(_told, schema)
