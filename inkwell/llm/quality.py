"""Quality rules with adaptive thresholds: DataFrame functions only.

The metrics of each text are computed inside its row with higher-order functions. Thresholds come from quantile sketches for
each language and source: a histogram of logarithmic buckets (the mergeable sketch of Masson, Rim and Lee, VLDB 2019, with
integer bucket bounds that are the same for all), which is merged by adding counts. So a hot source is pre-aggregated by every task, and the merged
sketch is the same in any order.

Every language and source has fences of its own, at every size: its sketch is blended with that of its language as if that
were PRIOR more documents, and the language's likewise with the sketch of everything. So a small group leans on its language,
and a large one speaks for itself, without a size at which the rule changes. With the quantiles of the blended sketch, the
fence of a metric is q + spread * (q - median), where q is the metric's upper quantile: the quartile for metrics that vary in
all texts, the 99th percentile for those that are 0 in most. No cutoff is fixed. A metric whose blended sketch has no spread
(q = median) doesn't judge. A document is kept if it passes the base rules and none of its metrics lies beyond its fence.

The table of thresholds has one row for each language and source. It is joined as it is: Spark broadcasts it only if its
measured size allows it, and splits a hot source otherwise. kept_rows() lets the columns of docs travel with the metrics, so
that the texts of a corpus aren't shuffled to meet their verdicts.

Defined results. Null text: no words, all metrics 0, base_failed. Null lang or source: a group of its own. Repeated rows: each
counts. Empty table: no rows. Extra columns are ignored by judge() and kept by kept_rows().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm import common

WINDOW, MIN_WORDS, MAX_REPEAT = 8, 20, 30
#: Documents that the parent's sketch stands for.
PRIOR = 50
#: metric -> (upper quantile in percent, spread). Metrics are integers: shares per thousand word characters, lines or words.
FENCES = {
    "punct_pm": (75, 12),
    "word_len_pm": (75, 12),
    "upper_pm": (75, 12),
    "dup_lines_pm": (99, 1),
    "repeat_pm": (99, 1),
}
#: Binary digits of a value that its bucket keeps: bounds are 0, 1, 2, ..., 128 and then 1/128 to 1/64 apart.
DIGITS = 7
#: Fixed value: the punctuation and symbols of ASCII.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def metrics(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, lang, source, the base columns and the adaptive rules' integer metrics, and with carry the row of docs as a struct.

    Each step is a projection of its own, which reads the arrays of the last one.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = [F.struct(*(docs[c] for c in docs.columns)).alias("_row")] if carry else []
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), *row, text.alias("t"))
    keep = ["doc_id", "lang", "source", *(["_row"] if carry else [])]
    less = lambda chars: (F.length("t") - F.length(F.translate("t", chars, ""))).cast("long")
    squeezed = F.trim(F.regexp_replace("t", r"[\x20\x09-\x0D]+", " "))
    df = df.select(
        *keep, squeezed.alias("s"), less("#*$%&|<>").alias("n_symbols"), less(PUNCTUATION).alias("n_punct"), less("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"),
        F.filter(F.split("t", "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0).alias("lines"),
    )
    df = df.select(
        *keep, "n_symbols", "n_punct", "n_upper", F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.length(F.translate("s", " ", "")).cast("long").alias("word_chars"),
        F.when(F.length("s") > 0, F.split("s", " ")).otherwise(F.array().cast("array<string>")).alias("w"),
    )
    plain = [*keep, "n_symbols", "n_punct", "n_upper", "n_lines", "n_dup_lines", "word_chars"]
    df = df.select(*plain, F.size("w").cast("long").alias("n_words"), F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    windows = F.transform(F.sequence(F.lit(1), F.size("h") - F.lit(WINDOW - 1)), lambda i: F.xxhash64(F.slice("h", i, WINDOW)))
    df = df.select(*plain, "n_words", F.when(F.col("n_words") > WINDOW, windows).alias("v"))
    # hash and place of every window, only where a window occurs twice
    ranked = F.sort_array(F.transform("v", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    df = df.select(*plain, "n_words", F.when(F.size(F.array_distinct("v")) < F.size("v"), ranked).alias("r"))
    twice = F.filter(F.transform("r", lambda e, k: F.when((F.get("r", k - 1)["x"] == e["x"]) | (F.get("r", k + 1)["x"] == e["x"]), e["i"])), lambda i: i.isNotNull())
    df = df.select(*plain, "n_words", F.sort_array(twice).alias("p"))
    covered = F.aggregate(F.transform("p", lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get("p", k + 1) - i, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    df = df.select(*plain, "n_words", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))
    per = lambda a, b: F.coalesce(F.expr(f"{a} * 1000 div nullif({b}, 0)"), F.lit(0))
    return df.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))).alias("base_failed"),
        per("n_punct", "word_chars").alias("punct_pm"), per("n_dup_lines", "n_lines").alias("dup_lines_pm"), per("n_repeat_words", "n_words").alias("repeat_pm"),
        per("word_chars", "n_words").alias("word_len_pm"), per("n_upper", "word_chars").alias("upper_pm"),
    )


def bucket(value: Column) -> Column:
    """The value with all but its DIGITS leading binary digits set to 0: a sketch bucket is named by its lower bound."""
    rest = F.greatest(F.length(F.bin(value)) - DIGITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, rest), rest)


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, n): one row for each bucket in use; sketches merge by adding n."""
    stacked = measured.filter(~F.col("base_failed")).select("lang", "source", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in FENCES))).alias("x"))
    # equal values first, so that the bucket of a value is looked up once
    counted = stacked.groupBy("lang", "source", "x.metric", "x.value").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("lang", "source", "metric", bucket(F.col("value")).alias("bucket")).agg(F.sum("n").alias("n"))


def merged(sketch: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, metric, <name>_rows, <name>): the merged sketch of each group as an array (bucket, n) in order, at most as long as there are buckets."""
    whole = sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    return whole.groupBy(*keys, "metric").agg(F.sum("n").cast("double").alias(f"{name}_rows"), F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias(name))


def thresholds(measured: DataFrame, prior: int = PRIOR) -> DataFrame:
    """(lang, source, t_<metric>...): the fences of each group, from its sketch blended with its language's and that with everything's."""
    sketch = common.materialize(sketches(measured), "quality-sketches")
    own = merged(sketch, ["lang", "source"], "own").withColumn("own", F.map_from_entries("own"))
    lang = merged(sketch, ["lang"], "of").select(F.col("lang").alias("l_lang"), F.col("metric").alias("l_metric"), "of_rows", F.map_from_entries("of").alias("of"))
    every = merged(sketch, [], "all").withColumnRenamed("metric", "w_metric")
    df = own.join(lang, own["lang"].eqNullSafe(F.col("l_lang")) & (own["metric"] == F.col("l_metric"))).join(every, own["metric"] == F.col("w_metric"))
    upper = F.lit(0.75)
    for m, (q, _) in FENCES.items():
        upper = F.when(F.col("metric") == m, F.lit(q / 100)).otherwise(upper)
    df = df.withColumn("upper", upper)
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")

    def step(acc: Column, x: Column) -> Column:
        g, l, a = acc["g"] + F.coalesce(F.col("own")[x["bucket"]], zero), acc["l"] + F.coalesce(F.col("of")[x["bucket"]], zero), acc["a"] + x["n"]
        below = (g + prior * ((l + prior * (a / F.col("all_rows"))) / (F.col("of_rows") + prior))) / (F.col("own_rows") + prior)
        reached = lambda at, q: F.coalesce(at, F.when(below >= q, x["bucket"]))
        return F.struct(g.alias("g"), l.alias("l"), a.alias("a"), reached(acc["mid"], F.lit(0.5)).alias("mid"), reached(acc["top"], F.col("upper")).alias("top"))

    df = df.withColumn("q", F.aggregate("all", F.struct(zero.alias("g"), zero.alias("l"), zero.alias("a"), none.alias("mid"), none.alias("top")), step))
    fence = {m: F.max(F.when((F.col("metric") == m) & (F.col("q.top") > F.col("q.mid")), F.col("q.top") + spread * (F.col("q.top") - F.col("q.mid")))).alias(f"t_{m}") for m, (_, spread) in FENCES.items()}
    return df.groupBy("lang", "source").agg(*fence.values())


def judged(measured: DataFrame, prior: int = PRIOR) -> DataFrame:
    """metrics() with the verdict `kept`; measured has been written."""
    fences = common.materialize(thresholds(measured, prior).select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), *(f"t_{m}" for m in FENCES)), "quality-thresholds")
    # a plain equality of keys, nulls included, leaves the join one that Spark can split
    key = lambda a, b: F.to_json(F.struct(F.col(a).alias("a"), F.col(b).alias("b")))
    joined = measured.withColumn("g", key("lang", "source")).join(fences.withColumn("g", key("g_lang", "g_source")), "g", "left")
    beyond = F.lit(False)
    for m in FENCES:
        beyond = beyond | F.coalesce(F.col(m) > F.col(f"t_{m}"), F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~beyond)


def judge(docs: DataFrame, prior: int = PRIOR) -> DataFrame:
    """metrics() of every document with its verdict `kept`."""
    return judged(common.materialize(metrics(docs), "quality-metrics"), prior)


def kept_rows(docs: DataFrame, prior: int = PRIOR) -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    return judged(common.materialize(metrics(docs, carry=True), "quality-metrics"), prior).filter("kept").select("_row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return judge(common.read(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def oracle() -> str:
    """DuckDB SQL for query(), with the same fences and bucket bounds."""
    quoted = lambda chars: chars.replace("'", "''")
    fold = lambda column, chars: f"length({column}) - length(translate({column}, '{quoted(chars)}', ''))"
    per = lambda a, b: f"coalesce({a} * 1000 // nullif({b}, 0), 0)"
    upper = "CASE metric " + " ".join(f"WHEN '{m}' THEN {q / 100}::DOUBLE" for m, (q, _) in FENCES.items()) + " END"
    spread = "CASE metric " + " ".join(f"WHEN '{m}' THEN {s}" for m, (_, s) in FENCES.items()) + " END"
    return rf"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - {WINDOW - 1})) AS i FROM w)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM g WHERE (doc_id, g) IN (SELECT (doc_id, g) FROM g GROUP BY doc_id, g HAVING count(*) > 1)) GROUP BY doc_id),
b AS (SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, ({fold('t', '#*$%&|<>')})::BIGINT AS n_symbols, ({fold('t', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')}) AS n_upper, ({fold('t', PUNCTUATION)}) AS n_punct,
        len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN r USING (doc_id)),
m AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed, {per('n_punct', 'word_chars')} AS punct_pm, {per('n_dup_lines', 'n_lines')} AS dup_lines_pm,
        {per('n_repeat_words', 'n_words')} AS repeat_pm, {per('word_chars', 'n_words')} AS word_len_pm, {per('n_upper', 'word_chars')} AS upper_pm FROM b),
v AS (SELECT doc_id, lang, source, base_failed, unnest([{', '.join(f"'{m}'" for m in FENCES)}]) AS metric, unnest([{', '.join(f'{m}::BIGINT' for m in FENCES)}]) AS value FROM m),
s AS (SELECT lang, source, metric, (value >> greatest(length(bin(value)) - {DIGITS}, 0)::INT) << greatest(length(bin(value)) - {DIGITS}, 0)::INT AS bucket, count(*) AS n FROM v WHERE NOT base_failed GROUP BY ALL),
a AS (SELECT metric, bucket, sum(sum(n)) OVER (PARTITION BY metric ORDER BY bucket) AS cum, sum(sum(n)) OVER (PARTITION BY metric) AS total FROM s GROUP BY metric, bucket),
l AS (SELECT k.lang, a.metric, a.bucket, sum(coalesce(x.n, 0)) OVER (PARTITION BY k.lang, a.metric ORDER BY a.bucket) AS cum, k.total
      FROM (SELECT lang, metric, sum(n) AS total FROM s GROUP BY ALL) k JOIN a ON a.metric = k.metric
      LEFT JOIN (SELECT lang, metric, bucket, sum(n) AS n FROM s GROUP BY ALL) x ON x.lang IS NOT DISTINCT FROM k.lang AND x.metric = a.metric AND x.bucket = a.bucket),
o AS (SELECT k.lang, k.source, a.metric, a.bucket, sum(coalesce(x.n, 0)) OVER (PARTITION BY k.lang, k.source, a.metric ORDER BY a.bucket) AS cum, k.total
      FROM (SELECT lang, source, metric, sum(n) AS total FROM s GROUP BY ALL) k JOIN a ON a.metric = k.metric
      LEFT JOIN s x ON x.lang IS NOT DISTINCT FROM k.lang AND x.source IS NOT DISTINCT FROM k.source AND x.metric = a.metric AND x.bucket = a.bucket),
f AS (SELECT o.lang, o.source, o.metric, o.bucket, (o.cum::DOUBLE + {PRIOR} * ((l.cum::DOUBLE + {PRIOR} * (a.cum::DOUBLE / a.total::DOUBLE)) / (l.total::DOUBLE + {PRIOR}))) / (o.total::DOUBLE + {PRIOR}) AS below
      FROM o JOIN l ON o.lang IS NOT DISTINCT FROM l.lang AND o.metric = l.metric AND o.bucket = l.bucket JOIN a ON o.metric = a.metric AND o.bucket = a.bucket),
q AS (SELECT lang, source, metric, min(bucket) FILTER (below >= 0.5::DOUBLE) AS mid, min(bucket) FILTER (below >= {upper}) AS top FROM f GROUP BY lang, source, metric),
x AS (SELECT DISTINCT v.doc_id FROM v JOIN (SELECT *, top + {spread} * (top - mid) AS fence FROM q WHERE top > mid) f ON v.lang IS NOT DISTINCT FROM f.lang AND v.source IS NOT DISTINCT FROM f.source AND v.metric = f.metric WHERE value > fence)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM x) AS kept FROM m
"""


ORACLE = oracle()
