"""Which texts contain which, by an inverted index of grams.

A text that contains another has all its grams. Every needle is filed under one
of its grams, the one that the fewest haystacks have; haystacks are listed under
all of theirs; the pairs that meet are verified. A needle with a gram that no
haystack has is done at once. Needles shorter than a gram are filed whole: they
are grams of their own length, which haystacks list too, so they need no path
through all texts either.

The join is keyed, so it is spread by gram, and a gram that very many haystacks
share is only met by needles that have no rarer one: what they then meet is
mostly what they return.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3


def _grams(text: Column, size: Column | int) -> Column:
    """Distinct grams of ``size`` code points; none in a shorter text."""
    size = F.lit(size) if isinstance(size, int) else size
    last = F.length(text) - size + 1
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(text, i, size))))


def containment_pairs(needles: DataFrame, hays: DataFrame, size: int = GRAM) -> DataFrame:
    """(needle, hay) for every pair of which the second contains the first.

    ``needles`` has a column ``needle``, ``hays`` a column ``hay``, each without
    repetitions; empty and null texts are in no pair.
    """
    none = F.array().cast("array<string>")
    every = F.concat(*[F.coalesce(_grams(F.col("hay"), k), none) for k in range(1, size + 1)])
    listed = hays.where("hay <> ''").select("hay", F.explode(every).alias("gram"))
    held = listed.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    own = _grams(F.col("needle"), F.least(F.length("needle"), F.lit(size)))
    filed = (
        needles.where("needle <> ''")
        .select("needle", F.explode(own).alias("gram"))
        .join(held, "gram", "left")
        .groupBy("needle")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("least"))
        .where("least.n > 0")
        .select("needle", F.col("least.gram").alias("gram"))
    )
    return filed.join(listed, "gram").where(F.contains("hay", "needle")).select("needle", "hay")
