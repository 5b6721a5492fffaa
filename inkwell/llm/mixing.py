"""Mixing sources to target weights by Sainte-Laguë apportionment: DataFrame functions only.

Targets: sources share the words of all by weight, but none beyond LIMIT times its own size; what is over is shared again by weight
until none is above. Sorted by limit over weight, a source stands at its limit if its share of what those before it leave is above it.

The words of the mix are equal blocks. Sainte-Laguë gives them to the sources with the highest quotients target / (2 j + 1), and each
source's blocks in the same way to its shards by their words. apportion() doesn't list all quotients: the divisors for n / 2 seats more
and fewer bound each quota from both sides, so that only a few quotients an entry are ranked, whatever the number of seats.

A shard's documents lie one after another in the order of a seeded hash, and are cut into the blocks. The words of its quota take all of
them a whole number of times, and of the rest the blocks that a seeded phase picks at even distances; so what a document has of the blocks taken
is a difference of two closed forms, and no block is ever a row. A hot source is cut into many shards, whose number follows its size.
Blocks are BLOCK words, or fewer where the smallest target is under FINE of them, so a small source comes as near to its target.

Defined results. Null text: size 0, taken 0. Null source: a source of its own, the last. Rows of one doc_id, source and size are one item
until its words are dealt out evenly to them; a null doc_id is like any other. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm import common

BLOCK, FINE, LIMIT, SEED = 256, 200, 3, "mix"
WEIGHTS = (1, 2, 3)
#: Words of a shard, and about as many shards at most.
SHARD, SHARDS = 1 << 18, 1 << 16


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def apportion(rows: DataFrame, weight: str, seats: str, by: list[str], order: list[str], out: str) -> DataFrame:
    """rows with the column out: the seats of each entry, of those that its group `by` has in all (the same number in each of its rows).

    order tells the entries of a group apart, and breaks ties. Entries of weight 0 get none.
    """
    group = Window.partitionBy(*by)
    w, m = F.col(weight).cast("double"), F.col(seats).cast("double")
    half = F.count(F.when(w > 0, 1)).over(group) / 2
    total = F.sum(w).over(group)
    bounded = rows.withColumns({"_total": total, "_half": half})
    at = lambda seats_: F.coalesce(F.floor(F.try_divide(w * seats_, F.col("_total")) + 0.5), F.lit(0)).cast("long")
    bounded = bounded.withColumns({"_low": F.greatest(at(m - F.col("_half")) - 1, F.lit(0).cast("long")), "_high": F.when(w > 0, at(m + F.col("_half")) + 1).otherwise(F.lit(0).cast("long"))}).drop("_total", "_half")
    bounded = bounded.withColumn("_open", F.col(seats) - F.sum("_low").over(group))  # before a row is several
    bounded = bounded.withColumn("_j", F.explode_outer(F.when(F.col("_high") > F.col("_low"), F.sequence("_low", F.col("_high") - 1))))
    quotient = w / (2 * F.col("_j") + 1)
    ranked = bounded.withColumn("_rank", F.row_number().over(group.orderBy(quotient.desc_nulls_last(), *(F.col(c).asc_nulls_last() for c in order), "_j")))
    won = F.count(F.when(F.col("_j").isNotNull() & (F.col("_rank") <= F.col("_open")), 1))
    return ranked.groupBy(*rows.columns, "_low").agg((F.col("_low") + won).alias(out)).drop("_low")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """(source, source_size, total, target) of sized (source, size): a row a source, so the windows over all of them see few rows."""
    rows = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    every, place = Window.partitionBy(), F.col("source").asc_nulls_last()
    turn = (F.row_number().over(Window.orderBy(place)) - 1) % len(weights)
    rows = rows.withColumn("weight", F.element_at(F.array(*(F.lit(w).cast("long") for w in weights)), turn + 1)).withColumns({"total": F.sum("source_size").over(every), "weights": F.sum("weight").over(every)})
    before = Window.orderBy(limit * F.col("source_size") / F.col("weight"), place).rowsBetween(Window.unboundedPreceding, -1)
    sum_ = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    rows = rows.withColumns({"_w": F.col("weights") - sum_("weight"), "_t": F.col("total") - limit * sum_("source_size")})
    rows = rows.withColumn("full", (limit * F.col("source_size")).cast("double") * F.col("_w") <= F.col("weight").cast("double") * F.col("_t"))
    over = lambda c: F.coalesce(F.sum(F.when(F.col("full"), F.col(c))).over(every), F.lit(0))
    share = (F.col("weight") * (F.col("total") - limit * over("source_size"))).cast("double") / (F.col("weights") - over("weight")).cast("double")
    return rows.select("source", "source_size", "total", F.when(F.col("full"), (limit * F.col("source_size")).cast("double")).otherwise(share).alias("target"))


def number(h: Column) -> Column:
    """The first 60 bits of a hexadecimal hash."""
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("long")


def quotas(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT, block: int = BLOCK) -> DataFrame:
    """targets() with block (words of a block), blocks (the source's quota) and shards."""
    rows = targets(sized, weights, limit)
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(Window.partitionBy())
    rows = rows.withColumn("block", F.greatest(F.least(F.floor(F.coalesce(least, F.lit(1.0)) / FINE), F.lit(block).cast("long")), F.lit(1).cast("long")))
    rows = rows.withColumn("_seats", F.expr("(2 * total + block) div (2 * block)"))
    rows = apportion(rows, "target", "_seats", [], ["source"], "blocks")
    words = F.greatest(F.lit(SHARD).cast("long"), F.ceil(F.col("total") / SHARDS))
    return rows.withColumn("shards", F.greatest(F.ceil(F.col("source_size") / words), F.lit(1).cast("long"))).drop("_seats", "total")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT, block: int = BLOCK, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every row: taken is the number of its words that the mix takes, repeats counted."""
    sized = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), n_words(docs["text"]).alias("size"))
    sized = common.materialize(sized, "mix-sizes")
    sources = common.materialize(quotas(sized, weights, limit, block), "mix-quotas").withColumnRenamed("source", "_source")
    items = sized.groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("copies"))
    items = items.withColumn("h", F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("size").cast("string"))))
    items = items.join(sources, items["source"].eqNullSafe(F.col("_source"))).drop("_source").withColumns({"shard": F.pmod(number(F.col("h")), F.col("shards")), "words": F.col("copies") * F.col("size")}).drop("shards")
    items = common.materialize(items, "mix-items")
    shards = items.groupBy("source", "shard", "blocks", "block").agg(F.sum("words").alias("shard_words"))
    shards = apportion(shards, "shard_words", "blocks", ["source"], ["shard"], "quota")
    n = F.ceil(F.col("shard_words") / F.col("block"))
    shards = shards.withColumn("n", F.greatest(n, F.lit(1).cast("long")))
    # the quota in words, as the last block of a shard is shorter
    shards = shards.withColumn("quota", F.least(F.col("quota") * F.col("block"), limit * F.col("shard_words")))
    phase = F.pmod(number(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce("source", F.lit("-")), F.col("shard").cast("string")))), F.col("n"))
    shards = shards.select(F.col("source").alias("_source"), F.col("shard").alias("_shard"), "n", F.expr("coalesce(quota div nullif(shard_words, 0), 0)").alias("passes"), F.expr("coalesce((quota % nullif(shard_words, 0) * n + shard_words div 2) div shard_words, 0)").alias("rest"), phase.alias("phase"))
    shards = common.materialize(shards, "mix-shards")
    placed = items.withColumn("end", F.sum("words").over(Window.partitionBy("source", "shard").orderBy("h", "doc_id", "size")))
    placed = placed.join(shards, placed["source"].eqNullSafe(F.col("_source")) & (placed["shard"] == F.col("_shard"))).withColumn("start", F.col("end") - F.col("words"))
    picked = lambda k: f"(({k}) * rest + phase) div n"  # noqa: E731  of the first k blocks

    def upto(x: str) -> str:
        return f"block * ({picked(f'{x} div block')}) + {x} % block * ({picked(f'{x} div block + 1')} - {picked(f'{x} div block')})"

    placed = placed.withColumn("all", F.expr(f"passes * words + ({upto('end')}) - ({upto('start')})"))
    copies = placed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("i"))
    return copies.select("doc_id", "source", "size", "source_size", "target", F.expr("all div copies + if(i < all % copies, 1, 0)").alias("taken"))


def query(spark, sf_dir: str) -> DataFrame:
    return mix(common.read(spark, sf_dir, "documents")).drop("source")


def oracle() -> str:
    """DuckDB SQL for query(). It lists and ranks all quotients."""
    upto = lambda x: f"block * ((({x} // block) * rest + phase) // n) + {x} % block * ((({x} // block + 1) * rest + phase) // n - (({x} // block) * rest + phase) // n)"
    number_ = lambda h: f"('0x' || substr({h}, 1, 15))::BIGINT"
    return rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [{', '.join(map(str, WEIGHTS))}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1]::BIGINT AS weight FROM d GROUP BY source),
a AS (SELECT *, sum(source_size) OVER ()::BIGINT AS total, sum(weight) OVER ()::BIGINT AS weights,
      coalesce(sum(weight) OVER w, 0)::BIGINT AS wb, coalesce(sum(source_size) OVER w, 0)::BIGINT AS sb FROM s
      WINDOW w AS (ORDER BY ({LIMIT} * source_size)::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, ({LIMIT} * source_size)::DOUBLE * (weights - wb) <= weight::DOUBLE * (total - {LIMIT} * sb) AS "full" FROM a),
g AS (SELECT source, source_size, total, CASE WHEN "full" THEN ({LIMIT} * source_size)::DOUBLE
      ELSE (weight * (total - {LIMIT} * coalesce(sum(source_size) FILTER ("full") OVER (), 0)))::DOUBLE / (weights - coalesce(sum(weight) FILTER ("full") OVER (), 0))::DOUBLE END AS target FROM f),
b AS (SELECT *, greatest(least(floor(coalesce(min(target) FILTER (target > 0) OVER (), 1) / {FINE})::BIGINT, {BLOCK}), 1) AS block,
      greatest(ceil(source_size / greatest({SHARD}, ceil(total / {SHARDS})))::BIGINT, 1) AS shards FROM g),
x AS (SELECT source, row_number() OVER (ORDER BY target / (2 * j + 1) DESC, source NULLS LAST) AS r, (2 * total + block) // (2 * block) AS seats
      FROM (SELECT *, unnest(range(0, ceil(target / block)::BIGINT + 2)) AS j FROM b WHERE target > 0)),
q AS (SELECT b.*, (SELECT count(*) FROM x WHERE x.source IS NOT DISTINCT FROM b.source AND r <= seats) AS blocks FROM b),
i AS (SELECT source, doc_id, size, count(*) AS copies, md5('{SEED}:' || coalesce(doc_id::VARCHAR, '-') || ':' || size) AS h FROM d GROUP BY ALL),
p AS (SELECT i.*, q.source_size, q.target, q.block, q.blocks, {number_('h')} % q.shards AS shard, copies * i.size AS words FROM i JOIN q ON i.source IS NOT DISTINCT FROM q.source),
h AS (SELECT source, shard, block, blocks, sum(words)::BIGINT AS shard_words FROM p GROUP BY ALL),
y AS (SELECT source, shard, row_number() OVER (PARTITION BY source ORDER BY shard_words::DOUBLE / (2 * j + 1) DESC, shard) AS r, blocks
      FROM (SELECT *, unnest(range(0, blocks + 1)) AS j FROM h WHERE shard_words > 0)),
k AS (SELECT source, shard, block, shard_words, greatest(ceil(shard_words / block)::BIGINT, 1) AS n, (SELECT count(*) FROM y WHERE y.source IS NOT DISTINCT FROM h.source AND y.shard = h.shard AND r <= y.blocks) AS quota FROM h),
z AS (SELECT * EXCLUDE (quota), least(quota * block, {LIMIT} * shard_words) AS quota FROM k),
m AS (SELECT source, shard, n, coalesce(quota // nullif(shard_words, 0), 0) AS passes, coalesce((quota % nullif(shard_words, 0) * n + shard_words // 2) // nullif(shard_words, 0), 0) AS rest, {number_(f"md5('{SEED}:' || coalesce(source, '-') || ':' || shard)")} % n AS phase FROM z),
e AS (SELECT *, (sum(words) OVER (PARTITION BY source, shard ORDER BY h, doc_id NULLS FIRST, size))::BIGINT AS "end" FROM p),
o AS (SELECT *, "end" - words AS start FROM e),
t AS (SELECT o.*, passes * words + ({upto('"end"')}) - ({upto('start')}) AS taken FROM o JOIN m ON o.source IS NOT DISTINCT FROM m.source AND o.shard = m.shard)
SELECT doc_id, size, source_size, target, (taken // copies + CASE WHEN c < taken % copies THEN 1 ELSE 0 END)::BIGINT AS taken FROM (SELECT *, unnest(range(0, copies)) AS c FROM t)
"""


ORACLE = oracle()
