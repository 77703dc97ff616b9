"""Small documents with the awkward cases that every operator must take."""

import random

from pyspark.sql import types as T

WORDS = [a + b for a in ("ka", "lo", "mi", "ren", "tas", "vu", "zor", "pel") for b in ("da", "fe", "gi", "hon", "ju", "ky", "lun", "no")]

#: Extra columns clash with names that operators give or use.
SCHEMA = T.StructType(
    [T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))]
    + [T.StructField(n, T.StringType()) for n in ("TEXT", "ref", "mid", "kept", "n_words", "component_id", "bits", "g")]
)


def prose(rng, n):
    out = []
    for _ in range(n):
        out.append(rng.choice(WORDS) + rng.choice(["", "", "", ",", ".\n" if rng.random() < 0.3 else "."]))
    return " ".join(out)


def edited(rng, text, share):
    return " ".join(rng.choice(WORDS) if rng.random() < share else w for w in text.split(" "))


def documents(seed=1, n=40):
    """(doc_id, text, lang, source) with copies, near copies, nulls, empties, repeats, non-ASCII and a long text."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        rows.append((i, prose(rng, rng.randint(3, 160)), rng.choice(["xx", "yy", None]), rng.choice(["s0", "s1", None])))
    base = prose(rng, 150)
    rows += [(100 + i, edited(rng, base, i / 100), "xx", "s0") for i in range(0, 14)]
    rows += [(200, rows[3][1], "xx", "s0"), (201, rows[3][1].upper(), "yy", None), (202, "  ".join(rows[3][1].split(" ")), None, "s1")]
    rows += [(300, None, None, None), (301, "", "xx", "s0"), (302, " \n\t ", "xx", "s0"), (303, "one", "xx", "s0"), (304, "ONE", "xx", "s0")]
    rows += [(None, rows[5][1], "xx", "s0"), (None, None, None, None), rows[7], rows[7], (305, "é" * 150 + "日本語 ß " * 40, "yy", "s1"), (306, "a" * 900, "yy", "s1")]
    rows += [(307, prose(rng, 4000), "xx", "s0"), (308, "# $ % & | < > * " * 30, "xx", "s0")]
    return rows


def frame(spark, rows):
    full = [(i, t, lang, s, None if t is None else len(t), "x", "x", "x", "x", "x", "x", "x", "x") for i, t, lang, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
