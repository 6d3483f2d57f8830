"""A weighted vocabulary of terms and term pairs from tagged prose."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kolanut import tables as t
from kolanut.functions.text import folded, sentences, tag_groups, tagged_spans


def scene_sentences(df: DataFrame, text: Column, tag: str | None = "scene_description",
                    keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per sentence of every tagged span (of the whole text when ``tag`` is None)."""
    spans = df.select(*keep, F.explode(tagged_spans(text, tag)).alias("span")) if tag else df.select(*keep, text.alias("span"))
    return spans.select(*keep, F.explode(sentences(F.col("span"))).alias("sentence"))


def tagged(df: DataFrame, groups: Mapping = t.DICTIONARY, anchored: bool = False,
           sentence: str = "sentence") -> DataFrame:
    """Adds ``terms``: a struct with one array of canonical terms per group."""
    low = df.withColumn("_low", folded(F.col(sentence)))
    return low.withColumn("terms", tag_groups(F.col("_low"), groups, anchored, fold=False)).drop("_low")


def _term_items(group: str) -> Column:
    return F.transform(F.col("terms")[group], lambda x: F.struct(F.lit(group).alias("grp"), x.alias("term")))


def _pair_items(left: str, right: str) -> Column:
    return F.flatten(F.transform(F.col("terms")[left], lambda a: F.transform(
        F.col("terms")[right], lambda b: F.struct(F.lit("pair").alias("grp"), F.concat_ws("|", a, b).alias("term")))))


def _counted(df: DataFrame, *items: Column) -> DataFrame:
    """Sentences explode into their own few items, and the counts combine map-side into a result
    that the dictionary bounds."""
    rows = df.select(F.explode(F.concat(*items)).alias("i")).select("i.*")
    return rows.groupBy("grp", "term").agg(F.count(F.lit(1)).alias("n"))


def grammar_counts(df: DataFrame, left: str = "shot", right: str = "move", groups: Mapping = t.DICTIONARY) -> DataFrame:
    """A4 and A5 in one pass: sentences per (group, term) and per (left|right) pair."""
    return _counted(df, *[_term_items(g) for g in groups], _pair_items(left, right))


def term_counts(df: DataFrame, groups: Mapping = t.DICTIONARY) -> DataFrame:
    """A4: sentences that contain a term, per group and term."""
    return _counted(df, *[_term_items(g) for g in groups])


def pair_counts(df: DataFrame, left: str = "shot", right: str = "move") -> DataFrame:
    """A5: sentences that contain both terms of a pair."""
    names = F.split("term", r"\|")
    return _counted(df, _pair_items(left, right)).select(
        F.get(names, F.lit(0)).alias("left"), F.get(names, F.lit(1)).alias("right"), "n")


def top_pairs(df: DataFrame, k: int = 60) -> DataFrame:
    """The k most frequent pairs; equal counts go by name."""
    return df.orderBy(F.desc("n"), "left", "right").limit(k)


def sentence_count(df: DataFrame) -> DataFrame:
    """Sentences scanned."""
    return df.agg(F.count(F.lit(1)).alias("sentences"))
