"""What ingestion does to stored tables: status changes, alias sets, replaced runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def game_status(games: DataFrame, active: DataFrame, logged: DataFrame) -> DataFrame:
    """``games`` with ``new_status``: scheduled games that the provider no longer lists are superseded, superseded ones with logs are final."""
    a = active.select("game_id").distinct().withColumn("_a", F.lit(True))
    logs = logged.select("game_id").distinct().withColumn("_l", F.lit(True))
    g = games.join(a, "game_id", "left").join(logs, "game_id", "left")
    new = F.when((F.col("status") == "scheduled") & F.col("_a").isNull(), "superseded").when((F.col("status") == "superseded") & F.col("_l"), "final").otherwise(F.col("status"))
    return g.withColumn("new_status", new).drop("_a", "_l")


def alias_sets(aliases: DataFrame) -> DataFrame:
    """Of ``(entity_id, source, alias)`` each entity's sorted aliases, overall and by source."""
    per = aliases.groupBy("entity_id", "source").agg(F.array_sort(F.collect_set("alias")).alias("a"))
    return per.groupBy("entity_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("a")))).alias("aliases"), F.array_sort(F.collect_list(F.struct("source", "a"))).alias("by_source"))


def replace_run(stored: DataFrame, new: DataFrame) -> DataFrame:
    """``stored`` with the rows of ``new`` in place of all rows of the same run and games."""
    return stored.join(new.select("run_id", "game_id").distinct(), ["run_id", "game_id"], "left_anti").unionByName(new)
