"""Files: season-partitioned Parquet, graded-prop CSV, nested JSON of games and props, exchange payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRADED = "game_date date, game_id long, player_name string, market string, sportsbook string, line_value double, over_odds int, under_odds int, actual double, _bad string"
PROPS = "games array<struct<id:long,home:string,away:string>>, props_by_game map<string,array<struct<player:string,market:string,line:double,over_odds:string,under_odds:string>>>"
FILLS = "array<struct<fill_id:string,ticker:string,side:string,count:string,yes_price_dollars:string,no_price_dollars:string,yes_price:string,no_price:string>>"


def write_seasons(rows: DataFrame, path: str) -> None:
    """Parquet in folders ``season=...``; only the seasons that ``rows`` has are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("season").parquet(path)


def read_seasons(spark: SparkSession, path: str, as_of: str | None = None, least: float = 5.0, defaults: dict[str, object] | None = None) -> DataFrame:
    """Games of ``least`` minutes or more up to ``as_of``; season and time filters prune folders and row groups. Absent columns get their default."""
    d = spark.read.parquet(path).where(F.col("minutes") >= least)
    if as_of is not None:
        d = d.where(F.col("game_date") <= F.to_date(F.lit(as_of)))
    return d.withColumns({c: F.lit(v) for c, v in (defaults or {}).items() if c not in d.columns})


def history(*parts: DataFrame) -> DataFrame:
    """All rows of all parts by column name; a game in two parts stays twice."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def read_graded(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Typed rows of graded-prop CSV files, and the lines that do not fit."""
    d = spark.read.schema(GRADED).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").csv(path)
    return d.where("_bad is null and line_value is not null").drop("_bad"), d.where("_bad is not null or line_value is null").select("_bad")


def read_props(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """``(game_id, player, market, line, over_odds, under_odds)`` of nested files, one object each or one a line; odds that are no whole number are null."""
    d = spark.read.schema(PROPS).option("multiLine", not lines).json(path)
    rows = d.select(F.explode("props_by_game").alias("game_id", "props")).select(F.col("game_id").try_cast("long").alias("game_id"), F.inline("props"))
    return rows.withColumns({c: F.col(c).try_cast("int") for c in ("over_odds", "under_odds")})


def fills_in(payload: Column) -> Column:
    """The fills of an exchange's payload: a positive count and a price of the own side in dollars, or else in cents, to four places."""
    def fill(x):
        own = lambda c: F.when(F.lower(x["side"]) == "yes", x[f"yes_{c}"]).otherwise(x[f"no_{c}"]).try_cast("double")
        return F.struct(x["fill_id"].alias("fill_id"), x["ticker"].alias("ticker"), F.lower(x["side"]).alias("side"), x["count"].try_cast("double").alias("count"),
                        F.round(F.coalesce(own("price_dollars"), own("price") / 100), 4).alias("price"))

    rows = F.transform(F.from_json(F.get_json_object(payload, "$.fills"), FILLS), fill)
    return F.filter(rows, lambda x: (x["count"] > 0) & x["price"].isNotNull())
