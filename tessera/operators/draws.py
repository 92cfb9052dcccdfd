"""Draws without repeats: every key goes through all of its items before any comes again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.chunk import placed


def draws_without_repeats(asks: DataFrame, items: DataFrame, seed: str, size: int = 1, least: int = 1) -> DataFrame:
    """(key, no, place, item): what the draw ``no`` (from 0) of a key gives, for asks (key, no) and distinct items (key, item).

    A draw gives ``size`` items. The draws of a key form turns; a turn deals out one permutation of its items, the order of
    a hash of seed, key, turn and item, and ends when fewer than ``least`` are left (then the next turn has all of
    them again). So a draw is a place in a permutation that its number alone gives, and no draw waits for another. Only permutations that are asked for
    are made, all in one numbering by range, so that a key with very many items is not sorted in one task. Keys without
    items, and null keys, give nothing.
    """
    held = items.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    rounds = F.greatest(F.floor(F.col("n") / size) + F.when(F.col("n") % size >= least, 1).otherwise(0), F.lit(1)).cast("long")
    asked = asks.select("key", "no").distinct()
    sized = held.select("key", rounds.alias("rounds"))
    turns = asked.join(sized, "key").select("key", F.floor(F.col("no") / F.col("rounds")).cast("long").alias("turn"), "rounds").distinct()
    text = lambda c: F.col(c).cast("string")
    mixed = turns.join(items, "key").withColumn("mix", F.unhex(F.md5(F.concat_ws("|", F.lit(seed), text("key"), text("turn"), text("item")))))
    dealt = placed(mixed, ["key", "turn"], ["mix", "item"], spare=("mix",))
    draw = F.floor(F.col("place") / size).cast("long")  # in its turn; what is left over at the end of one is not dealt
    drawn = dealt.where(draw < F.col("rounds")).select("key", (F.col("turn") * F.col("rounds") + draw).alias("no"), "place", "item")
    return drawn.join(asked, ["key", "no"], "left_semi").select("key", F.col("no").cast(asks.schema["no"].dataType).alias("no"), "place", "item")
