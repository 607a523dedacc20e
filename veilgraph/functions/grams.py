"""Containment as an equi-join: texts are looked up by the pieces of a fixed size that they hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a piece.
GRAM = 6


def pieces(texts: DataFrame, text: str, *keep: str) -> DataFrame:
    """(*keep, gram): the distinct GRAM-character pieces of a text; shorter texts are one piece."""
    size = F.least(F.char_length(text), F.lit(GRAM))
    cut = texts.where(F.length(text) > 0).select(*keep, text, F.explode(F.sequence(F.lit(1), F.char_length(text) - size + 1)).alias("at"), size.alias("size"))
    return cut.select(*keep, F.col(text).substr(F.col("at"), F.col("size")).alias("gram")).distinct()


def containing(needles: DataFrame, index: DataFrame, texts: DataFrame, by: str) -> DataFrame:
    """(by, needle, text): texts of the same group that contain a needle.

    needles(by, needle), texts(by, text), index = pieces(texts, "text", by, "text").  A needle is looked up by its
    piece with the shortest list in the group, then compared whole; needles shorter than GRAM are compared
    with the texts of their group.  Empty needles are contained nowhere.
    """
    own = needles.where(F.length("needle") > 0).distinct()
    lists = index.groupBy(by, "gram").agg(F.count("*").alias("length"))
    sized = pieces(own.where(F.char_length("needle") >= GRAM), "needle", by, "needle").join(lists, [by, "gram"], "left")
    rarest = sized.groupBy(by, "needle").agg(F.min_by("gram", F.struct(F.coalesce("length", F.lit(0)), "gram")).alias("gram"))
    holds = F.contains(F.col("text"), F.col("needle"))
    long = rarest.join(index, [by, "gram"]).where(holds).select(by, "needle", "text")
    short = own.where(F.char_length("needle") < GRAM).join(texts.distinct(), by).where(holds).select(by, "needle", "text")
    return long.union(short)
