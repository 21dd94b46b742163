"""Quality rules: base counts, and divergence of a text's histograms from its language's."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hexcadence.llm.base import free_names, map_rows, named, small_batches, stored

# White space of the word pattern, and the symbols that are counted.
SPACE = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"

_WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
#: White space that str.split() cuts at besides SPACE; texts without it are split the fast way.
_ODD_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search

CLASSES = ("lower", "upper", "digit", "blank", "line end", "stop", "symbol", "control", "two bytes", "three bytes", "four bytes")


def _class_of_byte() -> np.ndarray:
    """Class of a character by its first UTF-8 byte; later bytes count nowhere (the class after the last)."""
    out = np.full(256, len(CLASSES), np.uint8)
    for b in range(128):
        c = chr(b)
        if "a" <= c <= "z":
            out[b] = 0
        elif "A" <= c <= "Z":
            out[b] = 1
        elif "0" <= c <= "9":
            out[b] = 2
        elif c in " \t":
            out[b] = 3
        elif c in "\n\v\f\r":
            out[b] = 4
        elif c in ".,;:!?'\"()-":
            out[b] = 5
        else:
            out[b] = 6 if 32 < b < 127 else 7
    out[0xC2:0xE0], out[0xE0:0xF0], out[0xF0:0xF8] = 8, 9, 10
    return out


_CLASS = _class_of_byte()


def words_of(text: str) -> list[str]:
    return _WORDS(text) if _ODD_SPACE(text) else text.split()


def class_counts(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return np.bincount(_CLASS[data], minlength=len(CLASSES) + 1)[: len(CLASSES)]


def repeated_words(words: list[str]) -> int:
    """Words that lie in a window of three words found at least twice."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    times, covered, end = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


@dataclass(frozen=True)
class Rules:
    """Limits of the quality rules. Distances are Jensen-Shannon distances (root of the divergence in bits, 0 to 1)."""

    min_words: int = 50  #: fewer words fail
    max_repeat_percent: int = 50  #: more words in repeated windows fail
    min_class_chars: int = 200  #: shorter texts are not judged by character classes
    max_class_distance: float = 0.3
    min_common_words: int = 100  #: texts of fewer words are not judged by common words
    max_common_distance: float = 0.45
    common_share: float = 0.002  #: a word is common if it is at least this share of its language's words
    own_reference_share: float = 0.001  #: languages of this share of all words have their reference sent to every task
    min_reference_words: int = 5000  #: languages of fewer words are not judged by divergence


@dataclass
class References:
    """Histograms by language; None stands for all languages together and judges rows without a language. At most
    1/own_reference_share languages, each with at most 1/common_share words, so they can be sent to every task. Those
    of all other languages are the rows (lang, classes, common) of ``rare``, which are joined to the texts."""

    classes: dict[str | None, np.ndarray] = field(default_factory=dict)
    common: dict[str | None, dict[str, float]] = field(default_factory=dict)
    total: dict[str | None, int] = field(default_factory=dict)  #: words that were counted
    rare: DataFrame | None = None

    def of(self, lang: str | None) -> str | None:
        return lang if lang in self.classes else None


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms (each scaled to 1), in base 2; 0 if one is empty."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float(np.sqrt(max(0.0, d / 2)))


def _count_words(text: str, lang: str, min_words: int, held: int = 100_000):
    """Per task: rows (lang, word, n) and (lang, class number, n), flushed whenever ``held`` words are known."""

    def run(batches):
        words: dict[str | None, Counter] = {}
        classes: dict[str | None, np.ndarray] = {}

        def flush():
            rows = [(k, w, None, n) for k, c in words.items() for w, n in c.items()]
            rows += [(k, None, i, int(n)) for k, c in classes.items() for i, n in enumerate(c)]
            words.clear()
            classes.clear()
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["lang", "word", "class", "n"]
            )

        known = 0
        for batch in batches:
            for t, k in zip(batch.column(0), batch.column(1), strict=True):
                t, k = t.as_py() or "", k.as_py()
                found = words_of(t)
                if len(found) < min_words:
                    continue
                counter = words.setdefault(k, Counter())
                before = len(counter)
                counter.update(found)
                known += len(counter) - before
                classes[k] = classes.get(k, 0) + class_counts(t)
                if known > held:
                    yield flush()
                    known = 0
        yield flush()

    return run


def references(df: DataFrame, text: str, lang: str, rules: Rules) -> References:
    """Histograms of each language over all texts that have enough words.

    Words are counted in the tasks first, then summed up by (language, word). Of languages with own_reference_share
    of all words, those that make up ``common_share`` come to the driver: at most 1/common_share words for each of at
    most 1/own_reference_share languages. The others' references stay in Spark, one row for each language.
    """
    small_batches(df.sparkSession)
    counts = stored(
        df.select(named(text), named(lang).cast("string"))
        .mapInArrow(_count_words(text, lang, rules.min_words), "lang string, word string, class int, n bigint")
        .groupBy("lang", "word", "class")
        .agg(F.sum("n").alias("n")),
        "histograms",
    )
    words, classes = counts.where("word IS NOT NULL"), counts.where("class IS NOT NULL")
    sums = words.groupBy("lang").agg(F.sum("n").alias("total"))
    all_words = sums.agg(F.sum("total")).first()[0] or 0
    sums = stored(sums.where(F.col("lang").isNotNull()), "languages")
    own = F.col("total") >= rules.own_reference_share * all_words
    # At most 1/own_reference_share languages; they are broadcast, so a frequent language meets in no task.
    large = F.broadcast(sums.where(own))
    small = sums.where(~own & (F.col("total") >= rules.min_reference_words))
    every = words.groupBy("word").agg(F.sum("n").alias("n"))
    common = (
        words.join(large, "lang").where(F.col("n") >= rules.common_share * F.col("total"))
        .select("lang", "word", (F.col("n") / F.col("total")).alias("share"))
    ).unionByName(
        every.where(F.col("n") >= rules.common_share * all_words)
        .select(F.lit(None).cast("string").alias("lang"), "word", (F.col("n") / all_words).alias("share"))
    )
    by_class = classes.join(large, "lang").groupBy("lang", "class").agg(F.sum("n").alias("n")).unionByName(
        classes.groupBy("class").agg(F.sum("n").alias("n")).withColumn("lang", F.lit(None).cast("string"))
    )
    out = References({None: np.zeros(len(CLASSES))}, {None: {}}, {None: all_words})
    for r in by_class.collect():
        out.classes.setdefault(r["lang"], np.zeros(len(CLASSES)))[r["class"]] = r["n"]
        out.common.setdefault(r["lang"], {})
    for r in common.collect():
        out.common[r["lang"]][r["word"]] = r["share"]
    out.total |= {r["lang"]: r["total"] for r in sums.where(own).collect()}
    if not small.isEmpty():
        shares = (
            words.join(small, "lang").where(F.col("n") >= rules.common_share * F.col("total"))
            .groupBy("lang").agg(F.collect_list(F.struct("word", (F.col("n") / F.col("total")).alias("share"))).alias("common"))
        )
        sizes = (
            classes.join(small, "lang").groupBy("lang", "class", "total").agg(F.sum("n").alias("n"))
            .groupBy("lang", "total").agg(F.array_sort(F.collect_list(F.struct("class", "n"))).alias("classes"))
        )
        out.rare = stored(sizes.join(shares, "lang", "left").select("lang", "total", "classes", "common"), "references")
    return out


QUALITY = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("base_failed", T.BooleanType())]
    + [T.StructField(c, T.DoubleType()) for c in ("class_distance", "common_distance")]
    + [T.StructField("kept", T.BooleanType())]
)


def judge(text: str | None, lang: str | None, refs: References, rules: Rules) -> tuple:
    text = text or ""
    words = words_of(text)
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    n, chars, repeats = len(words), sum(map(len, words)), repeated_words(words)
    failed = n < rules.min_words or 100 * repeats > rules.max_repeat_percent * n
    # A language that is unknown here, or has too few words, has no reference that could judge.
    judged = lang is None or refs.total.get(lang, 0) >= rules.min_reference_words
    key = refs.of(lang)
    by_class = by_common = None
    if judged and len(text) >= rules.min_class_chars:
        by_class = distance(class_counts(text).astype(float), refs.classes[key])
    common = refs.common[key]
    if judged and n >= rules.min_common_words and common:
        times = Counter(words)
        own = np.array([times.get(w, 0) for w in common], float)
        ref = np.fromiter(common.values(), float, len(common))
        by_common = distance(np.append(own, n - own.sum()), np.append(ref, max(0.0, 1 - ref.sum())))
    far = (by_class or 0) > rules.max_class_distance or (by_common or 0) > rules.max_common_distance
    return (
        n, chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeats, failed, by_class, by_common, not failed and not far,
    )


def assess(
    df: DataFrame, text: str, lang: str, rules: Rules | None = None, refs: References | None = None,
    into: str = "quality", keep: list[str] | None = None,
) -> DataFrame:
    """Add ``into``: word and line counts, base_failed, both distances, and kept.

    A text fails the base rules with too few words or too many words in repeated windows. It is also dropped if its
    histogram of character classes or of common words is too far from its language's reference; texts shorter than
    the guards are not judged by that histogram (distance null). Rows without a language are judged by all languages
    together; languages of fewer than min_reference_words are judged by neither histogram. ``refs`` are counted over
    ``df`` unless given. Null is the empty text: no words, failed.

    Languages whose references are not sent to every task have them joined to their rows; the planner broadcasts the
    written table if it is small enough.
    """
    rules = rules or Rules()
    refs = refs or references(df, text, lang, rules)
    code, own, of = free_names(df, "lang_code", "reference", "reference_lang")
    sent = References(refs.classes, refs.common, refs.total)

    def judged(t, k, row):
        if row is None:
            return judge(t, k, sent, rules)
        classes = np.zeros(len(CLASSES))
        for x in row["classes"]:
            classes[x["class"]] = x["n"]
        common = {x["word"]: x["share"] for x in row["common"] or []}
        return judge(t, k, References({k: classes, None: classes}, {k: common, None: common}, {k: row["total"]}), rules)

    def make():
        def run(texts, langs, rows=None):
            rows = rows or [None] * len(texts)
            columns = zip(*[judged(t, k, x) for t, k, x in zip(texts, langs, rows, strict=True)], strict=True)
            kinds = [pa.int64()] * 5 + [pa.bool_()] + [pa.float64()] * 2 + [pa.bool_()]
            return pa.StructArray.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=QUALITY.fieldNames()
            )

        return run

    kept = [c for c in (df.columns if keep is None else keep) if c != into]
    rows = df.withColumn(code, named(lang).cast("string"))
    if refs.rare is None:
        return map_rows(rows, [text, code], into, QUALITY, make, kept)
    # Rows of the languages above meet no join.
    has = F.coalesce(F.col(code).isin([k for k in sent.classes if k is not None]), F.lit(True))
    table = refs.rare.select(F.col("lang").alias(of), F.struct("total", "classes", "common").alias(own))
    joined = rows.where(~has).join(table, F.col(code) == F.col(of), "left").drop(of)
    return map_rows(rows.where(has), [text, code], into, QUALITY, make, kept).unionByName(
        map_rows(joined, [text, code, own], into, QUALITY, make, kept)
    )
