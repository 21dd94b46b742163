"""Conversations whose messages quote each other: links from quotations, and texts without them."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hexcadence.llm.base import free_names, map_rows, named, stored
from hexcadence.llm.sharding import numbered

#: Letters of scripts without blanks between words: Thai, Lao, Myanmar, Khmer, kana, Han.
_UNSPACED = re.compile("[\u0e01-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")

_MARKS = re.compile(r"[ \t]*((?:>[ \t]?)+)")
_ATTRIBUTION = re.compile(r"\s*(?:On\b.*\bwrote:|.*\b(?:wrote|schrieb|escribió|a écrit) ?:)\s*")


def levels(text: str) -> list[tuple[int, str]]:
    """Runs of lines of one quote level: (number of > marks, lines without them)."""
    out: list[tuple[int, list[str]]] = []
    for line in text.split("\n"):
        m = _MARKS.match(line)
        depth, rest = (m.group(1).count(">"), line[m.end() :]) if m else (0, line)
        if out and out[-1][0] == depth:
            out[-1][1].append(rest)
        else:
            out.append((depth, [rest]))
    return [(d, "\n".join(x)) for d, x in out]


def normal(passage: str) -> str:
    """Lower case, white space runs as one blank: wrapping a passage anew doesn't change it."""
    return " ".join(passage.lower().split())


def _units(passage: str) -> set[str]:
    """A passage as a whole, its paragraphs and its lines, normalised; all that are not empty."""
    found = {normal(passage)} | {normal(p) for p in re.split(r"\n[ \t]*\n", passage)} | {normal(x) for x in passage.split("\n")}
    return found - {""}


def weight(unit: str) -> int:
    """Words of a normalised passage; in scripts without blanks each letter is one."""
    if not _UNSPACED.search(unit):
        return unit.count(" ") + 1
    return sum(max(1, len(_UNSPACED.findall(w))) for w in unit.split(" "))


def parse(text: str | None) -> tuple[str, int, list[tuple[int, str]]]:
    """The message without quotes and the lines that announce them, the number of quoted passages, and
    (level, normalised passage) of its own and quoted units."""
    runs = levels(text or "")
    own: list[str] = []
    quotes = 0
    units: list[tuple[int, str]] = []
    for i, (depth, passage) in enumerate(runs):
        if depth:
            quotes += 1
            units += [(depth, u) for u in _units(passage)]
            continue
        if i + 1 < len(runs):
            lines = passage.rstrip().split("\n")
            if _ATTRIBUTION.fullmatch(lines[-1]):
                passage = "\n".join(lines[:-1])
        if passage.strip() or len(runs) == 1:
            own.append(passage if len(runs) == 1 else passage.strip("\n"))
    body = "\n".join(own)
    units += [(0, u) for u in _units(body)]
    return body, quotes, units


_PARSED = T.StructType(
    [
        T.StructField("body", T.StringType()),
        T.StructField("n_quotes", T.LongType()),
        T.StructField("units", T.ArrayType(T.StructType([T.StructField("level", T.IntegerType()), T.StructField("hash", T.LongType()), T.StructField("words", T.LongType())]))),
    ]
)


def _parse_rows():
    from xxhash import xxh3_64_intdigest

    unit = pa.struct([("level", pa.int32()), ("hash", pa.int64()), ("words", pa.int64())])

    def signed(u: str) -> int:
        h = xxh3_64_intdigest(u.encode("utf-8", "surrogatepass"))
        return h - (1 << 64) if h >> 63 else h

    def run(texts):
        parsed = [parse(t) for t in texts]
        units = [
            [{"level": d, "hash": signed(u), "words": weight(u)} for d, u in sorted(set(p[2]))] for p in parsed
        ]
        return pa.StructArray.from_arrays(
            [pa.array([p[0] for p in parsed], pa.string()), pa.array([p[1] for p in parsed], pa.int64()), pa.array(units, pa.list_(unit))],
            names=_PARSED.fieldNames(),
        )

    return run


def linked(df: DataFrame, conv: str, turn: str, text: str) -> DataFrame:
    """Conversations without quotes, in reply order: ``body``, ``n_quotes``, ``reply_to`` and ``position`` are added.

    * Lines are told apart by their level of ``>`` marks. A message's body keeps the unquoted ones, without lines that
      announce a quote. Null texts have an empty body.
    * Passages (as a whole, by paragraph, by line) are normalised and hashed, however short. A passage's original is the
      first message of the conversation that has it unquoted.
    * ``reply_to`` is the earlier turn whose passages a message quotes at level 1 with the most words, or letters
      of scripts without blanks (the later turn on a tie); null if it quotes none. Deeper levels are what others had quoted, and don't decide.
    * ``position`` counts from 0 through the conversation, by the turn replied to (without a quote: the turn before),
      then the own turn; so a message comes after the one it answers, and answers to one message stand together.

    Null conversations are one conversation, null turns come last and are never quoted; repeated rows each give a row.
    Other columns stay; columns named like a result are replaced. Originals are pre-aggregated by (conversation, hash),
    and positions are numbered over ranges, so neither a frequent passage nor a huge conversation meets in one task.
    """
    results = ("body", "n_quotes", "reply_to", "position")
    plain = [c for c in df.columns if c not in results]
    uid, parsed, anchor, reply_uid, place_uid = free_names(df, "uid", "parsed", "anchor", "reply_uid", "place_uid")
    rows = stored(
        map_rows(df.select(*[named(c) for c in plain]).withColumn(uid, F.monotonically_increasing_id()), [text], parsed, _PARSED, _parse_rows),
        "messages",
    )
    key = F.struct(named(conv).alias("conv"))
    units = rows.select(
        F.col(uid).alias("uid"), F.coalesce(F.to_json(key), F.lit("")).alias("conv"), named(turn).cast("bigint").alias("turn"),
        F.explode(F.col(parsed)["units"]).alias("unit"),
    ).select("uid", "conv", "turn", "unit.*")
    first = units.where("level = 0 AND turn IS NOT NULL").groupBy("conv", "hash").agg(F.min("turn").alias("original"))
    quoted = units.where("level = 1").select("uid", "conv", "turn", "hash", "words")
    # Only passages that are quoted at all are looked up.
    replies = (
        quoted.join(first.join(quoted.select("conv", "hash").distinct(), ["conv", "hash"], "left_semi"), ["conv", "hash"])
        .where("turn IS NULL OR original < turn")
        .groupBy("uid", "original")
        .agg(F.sum("words").alias("words"))
        .groupBy("uid")
        .agg(F.max_by("original", F.struct("words", "original")).alias("reply_to"))
    )
    replies = stored(replies, "replies")
    joined = rows.join(replies.withColumnRenamed("uid", reply_uid), F.col(uid) == F.col(reply_uid), "left").drop(reply_uid)
    answered = joined.withColumn(anchor, F.coalesce(F.col("reply_to"), named(turn).cast("bigint") - 1))
    narrow = answered.select(F.col(uid).alias("uid"), named(conv).alias("conv"), F.col(anchor).alias("anchor"), named(turn).cast("bigint").alias("turn"))
    ordered = stored(numbered(narrow, ["conv", "anchor", "turn"], "row"), "ordered")
    starts = ordered.groupBy("conv").agg(F.min("row").alias("first"))
    place = ordered.join(starts.withColumnRenamed("conv", "of"), F.col("conv").eqNullSafe(F.col("of"))).select(
        F.col("uid").alias(place_uid), (F.col("row") - F.col("first")).alias("position")
    )
    return answered.join(place, F.col(uid) == F.col(place_uid)).select(
        *[named(c) for c in plain], F.col(parsed)["body"].alias("body"), F.col(parsed)["n_quotes"].alias("n_quotes"), "reply_to", "position"
    )
