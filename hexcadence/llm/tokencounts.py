"""Token counts of a document's fields or sections from one encoding of the whole document."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hexcadence.llm.base import free_names, map_rows, named
from hexcadence.llm.bpe import Encoder

RULES = ("first", "most", "split")

COUNTS = T.ArrayType(
    T.StructType([T.StructField("tokens", T.DoubleType()), T.StructField("crossing", T.LongType())])
)


def _spans_of_ends(ends: Column, length: Column) -> Column:
    """Sections that follow each other from 0; the last ends with the text."""
    return F.transform(
        ends,
        lambda end, i: F.struct(
            F.when(i == 0, 0).otherwise(F.element_at(ends, i)).cast("int").alias("start"), F.least(end, length).cast("int").alias("end")
        ),
    )


def line_spans(text: str | None) -> list[tuple[int, int]]:
    text = text or ""
    cuts, at = [0], text.find("\n")
    while at >= 0:
        cuts.append(at + 1)
        at = text.find("\n", at + 1)
    return list(zip(cuts, [*cuts[1:], len(text)], strict=True))


def token_spans(text: str, packed: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and end of each token in code points; a token with a part of a character covers all of it."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    char = np.cumsum((data & 0xC0) != 0x80) - 1  # of each byte
    ends = np.cumsum(lengths[np.frombuffer(packed, "<u4")])
    if not len(ends):
        return ends, ends
    return char[np.r_[0, ends[:-1]]], char[ends - 1] + 1


def allocate(first: np.ndarray, end: np.ndarray, spans: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of the tokens that touch it also lie outside of it.

    Sections are disjoint and in order; tokens come in order. A token meets the sections from the first that ends
    after it starts to the last that starts before it ends. ``first`` gives it to the first of these, ``most`` to the
    one with most of its characters (the earlier on a tie), ``split`` to each by its share of the token's characters
    that lie in sections. Tokens that meet no section are counted nowhere.
    """
    tokens, crossing = np.zeros(len(spans)), np.zeros(len(spans), np.int64)
    starts, ends = spans[:, 0], spans[:, 1]
    solid = np.flatnonzero(ends > starts)
    if not len(first) or not len(solid):
        return tokens, crossing
    low = np.searchsorted(ends[solid], first, side="right")
    high = np.searchsorted(starts[solid], end, side="left")  # beyond the last met
    met = np.maximum(0, high - low)
    token = np.repeat(np.arange(len(first)), met)
    section = solid[np.arange(len(token)) - np.repeat(np.cumsum(met) - met, met) + np.repeat(low, met)]
    inside = np.minimum(end[token], ends[section]) - np.maximum(first[token], starts[section])
    np.add.at(crossing, section[inside < (end - first)[token]], 1)
    head = np.r_[True, token[1:] != token[:-1]] if len(token) else np.zeros(0, bool)
    if rule == "split":
        whole = np.bincount(token, inside, len(first))
        np.add.at(tokens, section, inside / whole[token])
    else:
        if rule == "most":
            order = np.lexsort((section, -inside, token))
            token, section = token[order], section[order]
            head = np.r_[True, token[1:] != token[:-1]] if len(token) else head
        np.add.at(tokens, section[head], 1.0)
    return tokens, crossing


def attribute(
    df: DataFrame, text: str, vocab: str, sections: str | None = None, rule: str = "first",
    into: str = "section", keep: list[str] | None = None,
) -> DataFrame:
    """A row for each section of each document: struct ``into`` of number, start, end, tokens, crossing.

    The whole text is encoded once; tokens never see where a section ends. ``sections`` names a column of disjoint,
    ordered spans in code points (end exclusive); by default the lines of the text, line ends included, so that the
    counts of a document add up to its tokens. ``rule`` says who gets a token that crosses a boundary (``allocate``).
    Null and empty texts have one empty line. Null sections give no rows, empty sections no tokens. The join of tokens
    and sections stays inside a document: both lists are in order, so it takes one binary search per token.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    kept = [c for c in (df.columns if keep is None else keep) if c != into]
    (found,) = free_names(df, "found")
    dtype = T.ArrayType(
        T.StructType(
            [T.StructField("number", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]
            + list(COUNTS.elementType)
        )
    )
    kinds = [("number", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("tokens", pa.float64()), ("crossing", pa.int64())]

    def make():
        encoder = Encoder(vocab)
        lengths = encoder.merges.lengths

        def run(texts, given=None):
            columns, offsets = [[] for _ in kinds], [0]
            for i, packed in enumerate(encoder.batch(texts)):
                body = texts[i] or ""
                spans = line_spans(body) if sections is None else [(s["start"], s["end"]) for s in given[i] or []]
                spans = np.array(spans, np.int64).reshape(-1, 2)
                tokens, crossing = allocate(*token_spans(body, packed, lengths), spans, rule)
                for column, values in zip(columns, (np.arange(len(spans)), spans[:, 0], spans[:, 1], tokens, crossing), strict=True):
                    column.append(values)
                offsets.append(offsets[-1] + len(spans))
            flat = [pa.array(np.concatenate(c) if c else [], k) for c, (_, k) in zip(columns, kinds, strict=True)]
            return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(flat, names=[n for n, _ in kinds]))

        return run

    inputs = [text] if sections is None else [text, sections]
    rows = map_rows(df, inputs, found, dtype, make, kept)
    return rows.select(*[named(c) for c in kept], F.explode(found).alias(into))


def field_sections(df: DataFrame, fields: list[str], separator: str = "\n") -> DataFrame:
    """One text of several columns (null: empty) in ``document``, and the span of each in ``sections``.

    A field's span takes in the separator after it. Columns of these names are replaced.
    """
    parts = [F.coalesce(named(c).cast("string"), F.lit("")) for c in fields]
    ends, so_far = [], F.lit(0)
    for i, p in enumerate(parts):
        so_far = so_far + F.length(p) + (len(separator) if i < len(parts) - 1 else 0)
        ends.append(so_far)
    body = F.concat_ws(separator, *parts)
    return df.withColumns({"document": body, "sections": _spans_of_ends(F.array(*ends), F.length(body))})
