"""How far a text is from what it should be: character and word error rates, their means and gates."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from vellum.functions.markdown import SPACE, strip


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode's composed form, for which Spark has no function."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def normalized(text: Column, compose: bool = True) -> Column:
    """Stripped, composed, runs of white space as one blank."""
    return F.regexp_replace(nfc(strip(text)) if compose else strip(text), rf"(?U){SPACE}+", " ")


def _rate(distance: Column, truth: Column, guess: Column) -> Column:
    """Against an empty truth an empty guess has rate 0, any other 1."""
    return F.when(truth == 0, F.when(guess == 0, 0.0).otherwise(1.0)).otherwise(distance / truth)


def cer(truth: Column, guess: Column) -> Column:
    """Edits in characters for each character of the truth."""
    return _rate(F.levenshtein(truth, guess), F.length(truth), F.length(guess))


def edits(a: list, b: list) -> int:
    """Edit distance of two sequences: a bit a place, of a column of the table at a time, as integers of any length (Hyyrö's form of Myers' method)."""
    if len(a) < len(b):
        a, b = b, a
    rest = iter(a)
    if all(w in rest for w in b):  # what is only left out needs no table
        return len(a) - len(b)
    begin = next(i for i, (v, w) in enumerate(zip(a, [*b, None], strict=False)) if v != w)
    a, b = a[begin:], b[begin:]
    while b and a[-1] == b[-1]:
        a.pop(), b.pop()
    at: dict = {}
    for i, w in enumerate(a):
        at.setdefault(w, []).append(i)
    known = {}
    for w in set(b) & at.keys():
        bits = bytearray(len(a) // 8 + 1)
        for i in at[w]:
            bits[i >> 3] |= 1 << (i & 7)
        known[w] = int.from_bytes(bits, "little")
    every, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    more, less, out = every, 0, len(a)
    for w in b:
        same = known.get(w, 0)
        level = ((((same & more) + more) ^ more) | same | less) & every
        right, back = less | every & ~(level | more), more & level
        out += bool(right & last) - bool(back & last)
        right, back = (right << 1 | 1) & every, back << 1 & every
        more, less = back | every & ~(level | right), right & level
    return out


@F.pandas_udf(DoubleType())
def _wer(truth: pd.Series, guess: pd.Series) -> pd.Series:
    def rate(t, g):
        if t is None:
            return None
        t = [w for w in t.split(" ") if w]
        if g is None:
            return None if t else 1.0
        g = [w for w in g.split(" ") if w]
        return edits(t, g) / len(t) if t else float(bool(g))

    return pd.Series([rate(t, g) for t, g in zip(truth, guess, strict=True)], dtype="float64")


def wer(truth: Column, guess: Column) -> Column:
    """Edits in words, which blanks part, for each word of the truth."""
    return _wer(truth, guess)


def mean_by(rated: DataFrame, group: str, *rates: str) -> DataFrame:
    """Mean rates of each group and of all, under the label TOTAL."""
    means = rated.rollup(group).agg(F.grouping(group).alias("_all"), F.count("*").alias("n"), *[F.round(F.avg(r), 9).alias(r) for r in rates])
    return means.withColumn(group, F.when(F.col("_all") == 1, "TOTAL").otherwise(F.col(group))).drop("_all")


def gate(means: DataFrame, limits: dict[str, float]) -> DataFrame:
    """means with `passed`: every rate at or under its limit."""
    passed = F.lit(True)
    for rate, limit in limits.items():
        passed = passed & (F.col(rate) <= limit)
    return means.withColumn("passed", passed)
