"""Release feed: JSON releases to update channels, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capsort.functions import columns as C

SCHEMA = "array<struct<tag_name:string,name:string,prerelease:boolean,target_commitish:string,body:string,assets:array<struct<name:string,browser_download_url:string>>>>"


def channels(feeds: DataFrame, asset: str, column: str = "json") -> DataFrame:
    """branch, tag, is_prerelease, commit, asset_url, title, built_at, place: stable first, then by branch."""
    r = feeds.select(F.explode(F.from_json(column, SCHEMA)).alias("r")).select("r.*")
    stable, dev = F.col("tag_name") == "stable", F.col("tag_name").startswith("dev-")
    own = F.filter("assets", lambda a: a["name"] == asset)
    body = F.coalesce("body", F.lit(""))
    some = lambda c, other: F.when(c != "", c).otherwise(other)
    branch = some(C.note_value(body, "branch"), F.when(stable, "main").otherwise(F.substring("tag_name", 5, 1 << 30)))
    commit = F.left(some(C.note_value(body, "commit"), F.coalesce("target_commitish", F.lit(""))), F.lit(7))
    built = C.note_value(body, "built")
    return r.filter((stable | dev) & (F.size(own) > 0)).select(
        branch.alias("branch"), F.col("tag_name").alias("tag"), F.col("prerelease").alias("is_prerelease"), commit.alias("commit"), own[0]["browser_download_url"].alias("asset_url"),
        F.coalesce("name", "tag_name").alias("title"), F.when(built != "", built).alias("built_at"), F.when(stable, 0).otherwise(1).alias("place"))


def update_available(installed: Column, commit: Column) -> Column:
    """Whether the first 7 characters differ; unknown counts as different."""
    seven = lambda c: F.left(c, F.lit(7))
    unknown = installed.isNull() | (installed == "") | (installed == "unknown")
    return unknown | F.coalesce(seven(installed) != seven(commit), F.lit(True))


def channel(named: str, found: DataFrame) -> DataFrame:
    """The first channel of a branch, in the order of channels; no row if there is none."""
    return found.filter(F.col("branch") == named).orderBy("place", "branch", "tag").limit(1)
