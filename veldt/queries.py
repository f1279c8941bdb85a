"""The queries of the general operators for training data, and their SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt.functions.text import blank, clean_name
from veldt.operators.delimited import split_packed
from veldt.operators.skew import heavy_keys, key_stats
from veldt.operators.wide import to_long, to_wide
from veldt.session import table
from veldt.sources.records import distinct_records

QUARTILES = (0.25, 0.5, 0.75)


def _keyed(spark: SparkSession, d: str) -> list[tuple[str, DataFrame]]:
    """The distinct records of both tables as (key, value); a blank key is null."""
    users = distinct_records(table(spark, d, "interactions"))
    users = users.select(F.when(~blank(F.col("user_id")), F.col("user_id")).alias("key"), "value")
    names = distinct_records(table(spark, d, "user_features"))
    names = names.select(F.nullif(clean_name(F.col("feature_name")), F.lit("")).alias("key"), "value")
    return [("user_id", users), ("feature_name", names)]


def _heavy(spark: SparkSession, d: str) -> DataFrame:
    (a, x), (b, y) = [(f, heavy_keys(df, "key", "value", 0.02)) for f, df in _keyed(spark, d)]
    return x.withColumn("field", F.lit(a)).unionByName(y.withColumn("field", F.lit(b)))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _heavy(spark, d).select("field", "key_value")


def p2_heavy_report(spark: SparkSession, d: str) -> DataFrame:
    return _heavy(spark, d).select("field", "key_value", "n", "n_values", "total", F.round("share", 9).alias("share"), F.col("q0").alias("median"))


def p2_key_stats(spark: SparkSession, d: str) -> DataFrame:
    (a, x), (b, y) = [(f, key_stats(df, "key", "value", QUARTILES)) for f, df in _keyed(spark, d)]
    both = x.withColumn("field", F.lit(a)).unionByName(y.withColumn("field", F.lit(b)))
    return both.select("field", "key_value", "n", "n_values", "total", *[F.col(f"q{i}").alias(c) for i, c in enumerate(("p25", "p50", "p75"))])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return split_packed(table(spark, d, "content_metadata"), "media_guid", "media_genres", table(spark, d, "genre_names")).withColumnRenamed("value", "genre")


def p6_wide(spark: SparkSession, d: str) -> DataFrame:
    return to_wide(table(spark, d, "user_features"), table(spark, d, "feature_catalog"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return to_long(p6_wide(spark, d))


QUERIES = {f.__name__: f for f in (p2_found, p2_heavy_report, p2_key_stats, p4_found, p6_wide, p6_found)}

_KEYED = """
keyed AS (
  SELECT 'user_id' AS field, CASE WHEN regexp_matches(user_id, '[^\\s\\p{Z}\\x{1c}-\\x{1f}\\x{85}\\x{0b}]') THEN user_id END AS key_value, value
  FROM (SELECT DISTINCT user_id, item_id, value, event_type, days_ago FROM interactions)
  UNION ALL
  SELECT 'feature_name', nullif(trim(regexp_replace(lower(feature_name), '[^a-z0-9+]+', '_', 'g'), '_'), ''), value
  FROM (SELECT DISTINCT user_id, feature_name, value FROM user_features)),
per_field AS (SELECT field, count(*) AS rows_ FROM keyed GROUP BY field),
good AS (SELECT field, key_value, value FROM keyed WHERE value IS NOT NULL AND NOT isnan(value) AND NOT isinf(value)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY field, key_value ORDER BY value) AS r, count(*) OVER (PARTITION BY field, key_value) AS c FROM good),
q AS (
  SELECT field, key_value, sum(value) AS total, max(c) AS n_values,
    max(CASE WHEN r = greatest(1, ceil(0.25 * c)) THEN value END) AS p25, max(CASE WHEN r = greatest(1, ceil(0.5 * c)) THEN value END) AS p50,
    max(CASE WHEN r = greatest(1, ceil(0.75 * c)) THEN value END) AS p75
  FROM ranked GROUP BY 1, 2),
n AS (SELECT field, key_value, count(*) AS n FROM keyed WHERE key_value IS NOT NULL GROUP BY 1, 2),
stats AS (SELECT n.field, n.key_value, n.n, coalesce(n_values, 0) AS n_values, total, n.n / rows_ AS share, p25, p50, p75
  FROM n JOIN per_field USING (field) LEFT JOIN q ON q.field = n.field AND q.key_value = n.key_value)
"""

_CELLS = """
cells AS (
  SELECT f.user_id, c.attribute, c.kind, f.value, f.loaded_at, f.clean, substr(f.clean, length(c.attribute) + 2) AS rest,
    row_number() OVER (PARTITION BY f.rid ORDER BY length(c.attribute) DESC) AS longest
  FROM (SELECT *, row_number() OVER () AS rid, trim(regexp_replace(lower(feature_name), '[^a-z0-9+]+', '_', 'g'), '_') AS clean FROM user_features
        WHERE regexp_matches(user_id, '[^\\s\\p{Z}\\x{1c}-\\x{1f}\\x{85}\\x{0b}]')) f
  JOIN feature_catalog c ON f.clean = c.attribute OR starts_with(f.clean, c.attribute || '_')),
valid AS (
  SELECT user_id, attribute, loaded_at, CASE WHEN kind = 'category' THEN rest ELSE CAST(CAST(value AS BIGINT) AS VARCHAR) END AS value_text
  FROM cells WHERE longest = 1 AND ((kind = 'category' AND value = 1.0 AND rest <> '')
    OR (kind = 'number' AND clean = attribute AND value IS NOT NULL AND NOT isnan(value) AND NOT isinf(value)))),
latest AS (SELECT user_id, attribute, arg_max(value_text, loaded_at) AS value_text FROM valid GROUP BY 1, 2)
"""

ORACLES = {
    "p2_found": f"WITH {_KEYED} SELECT field, key_value FROM stats WHERE share >= 0.02",
    "p2_heavy_report": f"WITH {_KEYED} SELECT field, key_value, n, n_values, total, round(share, 9) AS share, p50 AS median FROM stats WHERE share >= 0.02",
    "p2_key_stats": f"WITH {_KEYED} SELECT field, key_value, n, n_values, total, p25, p50, p75 FROM stats",
    "p6_found": f"WITH {_CELLS} SELECT user_id, attribute, value_text FROM latest",
}

# The attributes of the catalogue table with their kinds.
ATTRIBUTES = {
    "account_tenure_days": "number", "country": "category", "device": "category", "device_count": "number", "fav_series": "category", "plan": "category",
    "plan_tier": "category", "region": "category", "sessions_30d": "number", "status": "category", "tenure": "category", "watch_minutes": "number",
}
_WIDE = ", ".join(f"CAST(max(CASE WHEN attribute = '{a}' THEN value_text END) AS {'VARCHAR' if k == 'category' else 'BIGINT'}) AS {a}" for a, k in ATTRIBUTES.items())
ORACLES["p6_wide"] = f"WITH {_CELLS} SELECT user_id, {_WIDE} FROM latest GROUP BY 1"
