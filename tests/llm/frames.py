"""Small frames of hard rows."""

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = "the cat sat on a mat while seven grey birds sang over cold water near old stone walls".split()


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", ",", "."]) for _ in range(n))


def hard_docs(spark, extra: bool = True):
    """Nulls in every column, empty and blank texts, a very long text, repeated rows and ids, clashing columns."""
    rows = [
        (1, prose(1, 80), "en", "a", 1),
        (1, prose(1, 80), "en", "a", 1),
        (2, prose(2, 120), None, None, None),
        (None, prose(3, 90), "en", "b", 1),
        (None, None, None, None, None),
        (3, None, "en", "a", 0),
        (4, "", "de", "c", 0),
        (5, " \t\n\r\x0b\x0c ", "de", "c", 7),
        (6, "é漢😀 x", "fr", "b", 5),
        (7, prose(7, 60_000), "en", "b", 1),
        (8, "x" * 30_000, "en", "b", 30_000),
        (9, "same text " * 40, "en", "a", 400),
        (10, "same text " * 40, "en", "c", 400),
    ]
    df = spark.createDataFrame(rows, DOCS)
    if not extra:
        return df
    names = "uid key body tokens quality found fingerprint component_id size target copies source_size shard slot row".split()
    from pyspark.sql import functions as F

    return df.withColumns({n: F.lit("mine") for n in names} | {"a.b c": F.lit(1)})


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)
