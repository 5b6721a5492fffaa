"""First-wins and best-wins deduplication. Rows carry an explicit `ordinal`, as Spark rows have no order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import text as T


def first_discoveries(rows: DataFrame, partition: list[str], name: str, status: str = "match_status") -> DataFrame:
    """UNRESOLVED rows only, the first of each normalised name."""
    w = Window.partitionBy(*partition, name).orderBy("ordinal")
    return rows.filter(F.col(status) == "UNRESOLVED").withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k")


def best_settings(rows: DataFrame, partition: list[str], key: str, confidence: str = "confidence") -> DataFrame:
    """For each key the row of highest confidence (null is lowest), the earlier one on a tie, at the place of the key's first row.

    Rows with a null key are all kept. `position` is the ordinal of that place.
    """
    best = F.max_by(F.struct(*rows.columns), F.struct(F.coalesce(confidence, F.lit(-1.0)), -F.col("ordinal")))
    keyed = rows.filter(F.col(key).isNotNull()).groupBy(*partition, key).agg(best.alias("row"), F.min("ordinal").alias("position")).select("row.*", "position")
    return keyed.unionByName(rows.filter(F.col(key).isNull()).withColumn("position", F.col("ordinal")))


def repeated(rows: DataFrame, partition: list[str], key: str, status: str | None = None) -> DataFrame:
    """All but the first row of each key, AMBIGUOUS rows and null keys left out."""
    rows = rows.filter(F.col(key).isNotNull())
    if status:
        rows = rows.filter(F.col(status) != "AMBIGUOUS")
    return rows.withColumn("k", F.row_number().over(Window.partitionBy(F.xxhash64(*partition, key), *partition, key).orderBy("ordinal"))).filter("k > 1").drop("k")


def setting_key(matched_id: Column, name: Column, attribute: Column, value_type: Column, value_json: Column, status: Column) -> Column:
    """Identity of a setting: the known entity or else the name, the attribute as given, the type and the canonical JSON; null for AMBIGUOUS."""
    who = F.when(matched_id.isNotNull(), F.concat(F.lit("id:"), matched_id)).when(name != "", F.concat(F.lit("name:"), name))
    return F.when((status != "AMBIGUOUS") & who.isNotNull(), F.to_json(F.array(who, F.coalesce(attribute, F.lit("")), F.coalesce(value_type, F.lit("")), F.coalesce(value_json, F.lit("")))))


def gold_ids(gold: DataFrame) -> DataFrame:
    """gold (episode_no, ordinal, entity_name, fact_key, decision) with gold_id: its parts are the name and the key, or the decision where there is no key."""
    key = F.when(F.length(F.coalesce("fact_key", F.lit(""))) > 0, F.col("fact_key")).otherwise(F.col("decision"))
    return occurrence_ids(gold, "episode_no", T.id_part(F.col("entity_name")), T.id_part(key))


def occurrence_ids(rows: DataFrame, episode: str, name: Column, key: Column) -> DataFrame:
    """gold_id episode-{n}:{name}:{key}:{k}, k counting equal identities from 1 in input order."""
    rows = rows.withColumns({"g_name": name, "g_key": key})
    k = F.row_number().over(Window.partitionBy(F.xxhash64(episode, "g_name", "g_key"), episode, "g_name", "g_key").orderBy("ordinal"))
    return rows.withColumn("gold_id", F.concat_ws(":", F.concat(F.lit("episode-"), F.col(episode).cast("string")), "g_name", "g_key", k.cast("string"))).drop("g_name", "g_key")
