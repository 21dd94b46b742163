"""Personal data: entities by form, and further identifiers from the contexts that entities have taught."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass
from hashlib import md5
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from hexcadence.llm.base import free_names, map_rows, named, small_batches, stored
from hexcadence.llm.quality import words_of

# The kinds in order, and their forms.
KINDS = ("email", "ip", "card", "phone")
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

_LOCAL_PART = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CARD, _PHONE = re.compile(CARD), re.compile(PHONE)
#: Numbers joined by single dots; four of them in a row are what IP matches, and no text is read twice for it.
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9]")
_LONG_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9]){12}")
_SPACES = " \t\n\v\f\r"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_HINT = re.compile(r"[0-9@]")
#: The rest of a word, and what follows it over single blanks if that is digits.
_REST = re.compile(r"[^\x20\x09-\x0D]*(?:\x20[(0-9][0-9().-]*(?=[\x20\x09-\x0D.,;]|$))*")
_EDGE = ".,;:!?\"'()[]{}<>"

FILTER_BITS = 24  #: power of two of the bits in the filter of patterns (2 MB)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << i % 2
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _octet(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) < 4 and int(digits or 0) < 256


def _emails(text: str):
    """The form's leftmost matches, found from each @: what stands before it may reach back to the last match."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and _LOCAL_PART.match(text, start - 1):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def _addresses(text: str):
    for m in _DOTTED.finditer(text):
        if m.group().count(".") < 3:
            continue
        parts, start = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            end = start + sum(map(len, parts[i : i + 4])) + 3
            if all(map(_octet, parts[i : i + 4])):
                yield start, end
            start = end + 1


def _words_with_hints(text: str):
    """Start and end of every word that holds a digit or @, with the digits that follow over single blanks."""
    at = 0
    while m := _HINT.search(text, at):
        start = 1 + max(max(text.rfind(c, at, m.start()) for c in _SPACES), at - 1)
        end = _REST.match(text, m.start()).end()
        yield start, end
        at = end


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) in code points, by kind and start; failing matches are dropped without a retry."""
    out = [(0, a, b) for a, b in _emails(text)]
    if _DIGITS.search(text):
        out += [(1, a, b) for a, b in _addresses(text)]
        if _LONG_DIGITS.search(text):
            for m in _CARD.finditer(text):
                digits = m.group().replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append((2, *m.span()))
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((3, *m.span()))
    return out


def fits(value: str) -> list[int]:
    """Kinds that an identifier of this look can be, besides the exact forms."""
    digits = sum("0" <= c <= "9" for c in value)
    marks = sum(c in ".:" for c in value)
    out = []
    if "@" in value[1:-1]:
        out.append(0)
    if marks >= 2 and digits and not set(value.lower()) - set("0123456789abcdef.:"):
        out.append(1)
    if digits >= 6 and not set(value) - set("0123456789 -.()/+"):
        out += [2] * (12 <= digits <= 19) + [3] * (digits <= 15)
    return out


def _named(word: str) -> str:
    """A word as it stands in patterns: long ones by their digest, as they may precede many identifiers."""
    return word if len(word) <= 120 else "#" + md5(word.encode("utf-8", "surrogatepass")).hexdigest()


def occurrences(text: str) -> list[tuple[int, int, int, str, bool, str, str]]:
    """(kind, start, end, value, seed, one word before, two words before) of entities and possible identifiers."""
    seeds = base_spans(text)
    taken = sorted((a, b) for _, a, b in seeds)
    found = [(k, a, b, True) for k, a, b in seeds]
    if "@" in text or _DIGITS.search(text):
        i = 0
        for first, last in _words_with_hints(text):
            value = text[first:last]
            a = first + len(value) - len(value.lstrip(_EDGE))
            b = last - len(value) + len(value.rstrip(_EDGE))
            while i < len(taken) and taken[i][1] <= a:
                i += 1
            if b - a < 5 or (i < len(taken) and taken[i][0] < b):
                continue
            found += [(k, a, b, False) for k in fits(text[a:b])]
    out = []
    words = [m.span() for m in _WORD.finditer(text)] if found else []
    starts = [x for x, _ in words]
    for k, a, b, seed in found:
        i = bisect_left(starts, a)
        if a and text[a - 1] not in _SPACES:
            i -= 1  # the start of the identifier's own word
        one = _named(text[slice(*words[i - 1])]) if i else ""
        two = f"{_named(text[slice(*words[i - 2])])} {one}" if i > 1 else ""
        out.append((k, a, b, re.sub(r"[\s().-]", "", text[a:b]).lower(), seed, one, two))
    return out


SPAN = T.StructType([T.StructField(c, T.IntegerType()) for c in ("kind", "start", "end")])
_SPANS = pa.list_(pa.struct([(c, pa.int32()) for c in ("kind", "start", "end")]))
_FOUND = T.ArrayType(
    T.StructType(
        list(SPAN)
        + [T.StructField("value", T.StringType()), T.StructField("seed", T.BooleanType())]
        + [T.StructField("one", T.StringType()), T.StructField("two", T.StringType())]
    )
)


@dataclass(frozen=True)
class Bootstrap:
    """Limits of the bootstrap."""

    rounds: int | None = None  #: times that scores go from instances to patterns and back; None: until they settle
    min_values: int = 3  #: different values that a context must precede to be a pattern
    min_confidence: float = 0.5  #: of a pattern, to score instances
    min_score: float = 0.6  #: of an instance, to be reported


def _text_key(text):
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


class _Hashes(dict):
    """Word -> 64-bit hash, each computed once."""

    def __missing__(self, word: str) -> int:
        self[word] = h = xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def _pair_hashes(h: np.ndarray) -> np.ndarray:
    """Hash of each two neighbours."""
    x = h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ (h[1:] + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both bits of a hash in the filter."""
    mask = np.uint64((1 << FILTER_BITS) - 1)
    return (h >> np.uint64(40)) & mask, (h >> np.uint64(16)) & mask


def _mark(batches):
    """Per task: rows (block of 64 bits, bits) of the filter that the patterns set."""
    blocks: dict[int, int] = {}
    for batch in batches:
        for p in batch.column(0).to_pylist():
            h = np.array(list(map(_Hashes().__getitem__, p.split(" "))), np.uint64)
            for place in _places(_pair_hashes(h) if len(h) > 1 else h):
                at = int(place[0])
                blocks[at >> 6] = blocks.get(at >> 6, 0) | 1 << (at & 63)
    bits = np.array(list(blocks.values()), np.uint64).view(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(blocks.keys(), pa.int32()), pa.array(bits, pa.int64())], names=["block", "bits"])


def _filter_of(patterns: DataFrame) -> np.ndarray:
    """Bits that every pattern has: of one size for any number of patterns; others may pass, none is lost."""
    marks = patterns.select("pattern").mapInArrow(_mark, "block int, bits bigint").groupBy("block").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[marks["block"].to_numpy()] = marks["bits"].to_numpy().view(np.uint64)
    return out


def _count_contexts(bits: np.ndarray, held: int = 100_000):
    """Per task: how often words and two-word sequences that pass the filter stand in the texts, whatever follows them;
    flushed whenever ``held`` are known."""

    def passing(h: np.ndarray) -> list[int]:
        one, two = _places(h)
        six, low = np.uint64(6), np.uint64(63)
        return np.flatnonzero((bits[one >> six] >> (one & low)) & (bits[two >> six] >> (two & low)) & np.uint64(1)).tolist()

    def flush(total: Counter) -> pa.RecordBatch:
        rows = [pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())]
        total.clear()
        return pa.RecordBatch.from_arrays(rows, names=["pattern", "n"])

    def run(batches):
        total: Counter = Counter()
        hashes = _Hashes()
        for batch in batches:
            for text in batch.column(0):
                words = words_of(text.as_py() or "")[:-1] if text.is_valid else []
                if not words:
                    continue
                if max(map(len, words)) > 120:
                    words = list(map(_named, words))
                h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
                total.update([words[i] for i in passing(h)])
                total.update([f"{words[i]} {words[i + 1]}" for i in passing(_pair_hashes(h))])
                if len(hashes) > held:
                    hashes.clear()
                if len(total) > held:
                    yield flush(total)
        yield flush(total)

    return run


def discover(df: DataFrame, text: str, limits: Bootstrap | None = None) -> DataFrame:
    """Rows (text_key, added): spans that contexts give away, for each text that has some.

    1. Every text gives its entities (seeds) and its other identifier-like strings, with the words before them.
    2. The words before become lexical patterns if they precede enough different values of a kind.
    3. One more scan counts how often a pattern's words occur at all; an entity must usually follow them.
    4. On the graph of patterns and instances, scores go back and forth: a pattern's confidence is the scored share
       of its occurrences, an instance's score is what its confident patterns give it together (seeds have 1).
    5. Instances that are no seeds, but score high, are reported where a confident pattern precedes them.

    Values are counted once however many copies a text has. All tables are keyed and grouped in Spark. Patterns need
    no bound: tasks get a filter of fixed size, and what passes it is semi-joined with the patterns.
    """
    limits = limits or Bootstrap()
    spark = df.sparkSession
    key, body, found = "text_key", "body", "found"

    def make():
        kind = pa.list_(
            pa.struct([(c, pa.int32()) for c in ("kind", "start", "end")] + [("value", pa.string()), ("seed", pa.bool_()), ("one", pa.string()), ("two", pa.string())])
        )
        names = _FOUND.elementType.fieldNames()
        return lambda texts: pa.array([[dict(zip(names, o, strict=True)) for o in occurrences(t or "")] for t in texts], kind)

    source = df.select(named(text).alias(body))
    rows = map_rows(source.withColumn(key, _text_key(F.col(body))), [body], found, _FOUND, make, [key])
    seen = stored(
        rows.where(F.size(found) > 0).select(key, F.explode(found).alias("o")).select(key, "o.*").select(
            "*", F.explode(F.array("one", "two")).alias("pattern")
        ).where("pattern != ''").drop("one", "two"),
        "occurrences",
    )
    edges = stored(
        seen.groupBy("pattern", "kind", "value").agg(F.count(F.lit(1)).alias("n"), F.max("seed").alias("seed")), "graph"
    )
    patterns = stored(
        edges.groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("values"))
        .where(F.col("values") >= limits.min_values).select("pattern").distinct(),
        "patterns",
    )
    small_batches(spark)
    bits = _filter_of(patterns)
    totals = stored(
        source.select(body).mapInArrow(_count_contexts(bits), "pattern string, n bigint")
        .groupBy("pattern").agg(F.sum("n").alias("total")).join(patterns, "pattern", "left_semi"),
        "contexts",
    ) if bits.any() else spark.createDataFrame([], "pattern string, total bigint")
    graph = stored(edges.join(totals, "pattern"), "graph")
    scores = graph.groupBy("kind", "value").agg(F.max("seed").cast("double").alias("score"))
    confident = before = None
    for _ in islice(count(), limits.rounds):
        confident = (
            graph.join(scores, ["kind", "value"])
            .groupBy("pattern", "kind")
            .agg((F.sum(F.col("n") * F.col("score")) / F.max("total")).alias("confidence"))
            .where(F.col("confidence") >= limits.min_confidence)
        )
        given = (
            graph.join(confident, ["pattern", "kind"])
            .groupBy("kind", "value")
            .agg((1 - F.exp(F.sum(F.log1p(-F.least(F.col("confidence"), F.lit(0.999)))))).alias("given"))
        )
        scores = stored(
            scores.join(given, ["kind", "value"], "left").select(
                "kind", "value", F.when(F.col("score") == 1, 1.0).otherwise(F.coalesce("given", F.lit(0.0))).alias("score")
            ),
            "scores",
        )
        # Scores only rise, and patterns pass the limit by them.
        total = scores.agg(F.sum("score")).first()[0] or 0.0
        if limits.rounds is None and before is not None and total - before < 1e-6:
            break
        before = total
    hits = (
        seen.where("NOT seed")
        .join(confident.select("pattern", "kind"), ["pattern", "kind"], "left_semi")
        .join(scores.where(F.col("score") >= limits.min_score), ["kind", "value"])
        .groupBy(key, "start", "end")
        .agg(F.min_by("kind", F.struct(-F.col("score"), "kind")).alias("kind"))
    )
    # A text's identifiers are bounded by its length.
    return stored(hits.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("added")), "discovered")


def find(
    df: DataFrame, text: str, added: DataFrame | None = None, into: str = "pii", keep: list[str] | None = None
) -> DataFrame:
    """Add ``into``: arrays ``base`` and ``spans`` of (kind number, start, end), by kind and start.

    ``base`` holds what the forms match; ``spans`` holds these and what ``discover`` (run here unless given) adds.
    Null is the empty text, which has no spans. Equal texts get equal spans. Other columns stay as they are; one
    named ``into`` is replaced. The added spans are joined by the text's digest: the planner broadcasts their file
    if it is small enough.
    """
    kept = [c for c in (df.columns if keep is None else keep) if c != into]
    rows, more = _with_added(df, text, added)

    def make():
        def run(texts, extra):
            base = [base_spans(t or "") for t in texts]
            spans = [sorted(b + _as_tuples(x)) for b, x in zip(base, extra, strict=True)]
            return pa.StructArray.from_arrays([_as_structs(base), _as_structs(spans)], names=["base", "spans"])

        return run

    dtype = T.StructType([T.StructField("base", T.ArrayType(SPAN)), T.StructField("spans", T.ArrayType(SPAN))])
    return map_rows(rows, [text, more], into, dtype, make, kept)


def _with_added(df: DataFrame, text: str, added: DataFrame | None) -> tuple[DataFrame, str]:
    """The rows with their text's added spans, joined by digest, and that column's name."""
    added = discover(df, text) if added is None else added
    key, more = free_names(df, "text_key", "added")
    right = added.select(F.col("text_key").alias(key), F.col("added").alias(more))
    return df.withColumn(key, _text_key(named(text))).join(right, key, "left").drop(key), more


def _as_tuples(spans) -> list[tuple[int, int, int]]:
    return [(s["kind"], s["start"], s["end"]) for s in spans or []]


def _as_structs(rows) -> pa.Array:
    return pa.array([[dict(zip(SPAN.fieldNames(), s, strict=True)) for s in r] for r in rows], _SPANS)


def listed(spans) -> F.Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def counted(spans, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("bigint")


def redact(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with every span replaced by its kind; of overlapping spans the first, the longest if they start alike."""
    if text is None or not spans:
        return text
    out, end = [], 0
    for a, b, k in sorted(((a, b, k) for k, a, b in spans), key=lambda s: (s[0], -s[1], s[2])):
        if a >= end:
            out += [text[end:a], f"[{KINDS[k].upper()}]"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def mask(df: DataFrame, text: str, added: DataFrame | None = None) -> DataFrame:
    """Replace every span that ``find`` would report in ``text`` by its kind, in one pass; null stays null."""
    rows, more = _with_added(df, text, added)
    (body,) = free_names(df, "body")

    def make():
        return lambda texts, extra: pa.array(
            [redact(t, base_spans(t or "") + _as_tuples(x)) for t, x in zip(texts, extra, strict=True)], pa.string()
        )

    masked = map_rows(rows, [text, more], body, T.StringType(), make, [c for c in df.columns if c != text])
    return masked.select(*[(F.col(body) if c == text else named(c)).alias(c) for c in df.columns])
