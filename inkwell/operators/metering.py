"""Token bounds and the ledger of reserved and settled tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the bounds: share added to a count, and tokens added for framing.
MARGIN, FRAMING, BYTE_FRAMING, EMBED_FRAMING = 1.10, 256, 512, 256


def bound_from_tokens(tokens: Column, max_output: int) -> Column:
    return (F.ceil(tokens * F.lit(MARGIN)) + FRAMING + max_output).cast("long")


def bound_from_bytes(text: Column, max_output: int) -> Column:
    return (F.octet_length(F.coalesce(text, F.lit(""))) + max_output + BYTE_FRAMING).cast("long")


def embedding_bound(texts: DataFrame, by: list[str], text: str) -> DataFrame:
    return texts.groupBy(*by).agg((F.coalesce(F.sum(F.octet_length(text)), F.lit(0)) + EMBED_FRAMING).cast("long").alias("reserved_tokens"))


def settle(events: DataFrame) -> DataFrame:
    """Final state of each request from its events (request_id, ordinal, event, purpose, model, reserved, input, cached, output).

    Repeated events count once. A request with a settle event whose usage is known is SETTLED, with a release or a settle event
    without usage RELEASED, otherwise RESERVED; attempt counts its reservations.
    """
    once = events.dropDuplicates(["request_id", "ordinal", "event"])
    usage = F.when((F.col("event") == "settle") & F.col("input").isNotNull(), F.struct("ordinal", "input", "cached", "output"))
    out = once.groupBy("request_id").agg(
        F.first("purpose", True).alias("purpose"), F.first("model", True).alias("model"), F.max("reserved").alias("reserved"), F.count(F.when(F.col("event") == "reserve", 1)).alias("attempts"),
        F.max(usage).alias("u"), F.max(F.col("event").isin("release", "settle")).alias("over"),
    )
    state = F.when(F.col("u").isNotNull(), "SETTLED").when(F.col("over"), "RELEASED").otherwise("RESERVED")
    return out.select("request_id", "purpose", "model", "reserved", "attempts", state.alias("state"), "u.input", "u.cached", "u.output")


def report(requests: DataFrame, by: list[str], reserved: str = "reserved", used: str = "input", cached: str = "cached") -> DataFrame:
    """Calls, cache hits, cached share, mean reservation and mean reservation over use, each group in one pass."""
    share = F.try_divide(F.sum(cached), F.sum(used))
    return requests.groupBy(*by).agg(
        F.count(F.lit(1)).alias("calls"), F.count(F.when(F.col(cached) > 0, 1)).alias("cache_hits"), F.sum(used).alias("input_tokens"), F.sum(cached).alias("cached_tokens"),
        F.round(share, 6).alias("cached_share"), F.round(F.avg(reserved), 6).alias("mean_reserved"), F.round(F.avg(F.try_divide(F.col(reserved), F.col(used))), 6).alias("mean_reserved_over_used"),
    )
