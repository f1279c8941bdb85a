"""The queries of the recommender operators over the test tables, with the SQL that each is checked against."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt.functions import features as ft
from veldt.functions import weighting as wt
from veldt.operators import affinity, ann, linear, mappings, metrics, quality, recommenders, sequences, splits
from veldt.session import table
from veldt.sources.io import METADATA, as_number, as_text, validate
from veldt.streaming.counts import windowed_scores

AS_OF = "2024-01-31"
WEIGHTS = {"purchase": 5.0, "signup": 3.0, "click": 0.5}
LAMBDA = 150.0
BALANCE = ([0.0, 2500.0, 5000.0, 7500.0], ["0", "2500", "5000", "7500", "more"])

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Shared inputs.


def events(spark: SparkSession, d: str) -> DataFrame:
    """Interactions (with event_id) from the events table."""
    e = table(spark, d, "events")
    days = F.datediff(F.lit(AS_OF).cast("date"), F.to_date("ts")).cast("double")
    return e.select("event_id", F.col("user_id").cast("string").alias("user_id"), F.get_json_object("props", "$.k").alias("item_id"), "value", "event_type", days.alias("days_ago"))


E = f"""ev AS (SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, json_extract_string(props, '$.k') AS item_id, value, event_type,
  CAST(date_diff('day', CAST(ts AS DATE), DATE '{AS_OF}') AS DOUBLE) AS days_ago FROM events)"""


def orders(spark: SparkSession, d: str) -> DataFrame:
    """Interactions of customers with suppliers; integer quantities, so sums are exact."""
    li, o = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity"), table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").cast("string").alias("user_id"), F.col("l_suppkey").cast("string").alias("item_id"), F.col("l_quantity").alias("value"))


X = """x AS MATERIALIZED (SELECT CAST(o_custkey AS VARCHAR) AS u, CAST(l_suppkey AS VARCHAR) AS i, sum(l_quantity) AS v
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""


def customer_features(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").withColumn("user_id", F.col("c_custkey").cast("string"))
    t = ft.Transform().add_categorical("c_mktsegment", "segment_").add_numeric("c_acctbal", "balance", *BALANCE)
    return t.apply(c, "user_id")


_BUCKET = "CASE WHEN {c} IS NULL THEN 'unknown' WHEN {c} <= 0 THEN '0' WHEN {c} <= 2500 THEN '2500' WHEN {c} <= 5000 THEN '5000' WHEN {c} <= 7500 THEN '7500' ELSE 'more' END"
U = f"""uf AS (SELECT CAST(c_custkey AS VARCHAR) AS user_id, 'segment_' || coalesce(c_mktsegment, 'unknown') AS feature_name, 1.0::DOUBLE AS value FROM customer
  UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'balance_' || {_BUCKET.format(c="c_acctbal")}, 1.0 FROM customer)"""


def supplier_features(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").withColumn("item_id", F.col("s_suppkey").cast("string"))
    return ft.Transform().add_categorical("s_nationkey", "nation").apply(s, "item_id")


T = "tf AS (SELECT CAST(s_suppkey AS VARCHAR) AS item_id, 'nation_' || CAST(s_nationkey AS VARCHAR) AS feature_name, 1.0::DOUBLE AS value FROM supplier)"


# Sources and feature engineering.


@query(f"WITH {E} SELECT DISTINCT user_id, item_id, round(ln(value + 1), 6) AS value, event_type, days_ago FROM ev WHERE value >= 1.0 AND user_id IS NOT NULL AND item_id IS NOT NULL")
def interactions_from_events(spark, d):
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k"))
    rows = ft.interactions_from_views(e, "user_id", "k", "value", "ts", "event_type", AS_OF, 1.0)
    return rows.withColumn("value", F.round("value", 6)).distinct()


@query("SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS user_id, CAST(l_partkey AS VARCHAR) AS item_id, round(ln(l_extendedprice + 1), 6) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_extendedprice >= 30")
def interactions_from_orders(spark, d):
    li = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = ft.interactions_from_views(li, "o_custkey", "l_partkey", "l_extendedprice", min_seconds=30.0)
    return rows.withColumn("value", F.round("value", 6)).distinct()


@query("SELECT " + ", ".join(METADATA) + " FROM content_metadata")
def metadata_validated(spark, d):
    return validate(table(spark, d, "content_metadata"), METADATA)


@query("""SELECT coalesce(user_id, '') AS user_id, coalesce(feature_name, '') AS feature_name, CASE WHEN NOT isnan(coalesce(value, 0.0)) THEN coalesce(value, 0.0) END AS value,
  isnan(coalesce(value, 0.0)) AS not_a_number, count(*) AS n FROM user_features GROUP BY 1, 2, 3, 4""")
def features_cast_on_read(spark, d):
    """All rows as the tolerant readers give them; NaN is one value, shown as null with a flag."""
    rows = table(spark, d, "user_features").select(as_text("user_id").alias("user_id"), as_text("feature_name").alias("feature_name"), as_number("value").alias("value"))
    rows = rows.groupBy("user_id", "feature_name", "value").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", "feature_name", F.when(~F.isnan("value"), F.col("value")).alias("value"), F.isnan("value").alias("not_a_number"), "n")


_MELT = ["media_type", "media_audio_language", "media_series_title", "airtable_primary_genre"]


@query("SELECT DISTINCT * FROM (" + " UNION ALL ".join(f"SELECT media_guid, '{c}_' || {c} AS feature_name, 1.0::DOUBLE AS value FROM content_metadata WHERE {c} IS NOT NULL" for c in _MELT) + ")")
def melt_item_features(spark, d):
    return ft.melt(table(spark, d, "content_metadata"), "media_guid", _MELT)


@query("SELECT media_guid, 'tag_' || regexp_replace(t, '^ +| +$', '', 'g') AS feature_name, 1.0::DOUBLE AS value FROM (SELECT media_guid, unnest(string_split(media_tags, ',')) AS t FROM content_metadata)")
def split_explode_tags(spark, d):
    return ft.split_explode(table(spark, d, "content_metadata"), "media_guid", "media_tags", "tag_")


@query(f"SELECT c_custkey, 'balance_' || {_BUCKET.format(c='c_acctbal')} AS bucket FROM customer")
def bucketize_balance(spark, d):
    return table(spark, d, "customer").select("c_custkey", ft.bucket(F.col("c_acctbal"), *BALANCE, prefix="balance_").alias("bucket"))


@query(f"WITH {U} SELECT * FROM uf")
def declarative_transform(spark, d):
    return customer_features(spark, d)


@query("""SELECT DISTINCT item_id, feature_name, value FROM (
  SELECT media_guid AS item_id, 'media_type_' || media_type AS feature_name, 1.0::DOUBLE AS value FROM content_metadata WHERE media_type IS NOT NULL
  UNION ALL SELECT media_guid, 'genre_' || regexp_replace(g, '^ +| +$', '', 'g'), 1.0 FROM (SELECT media_guid, unnest(string_split(media_genres, ',')) AS g FROM content_metadata))
WHERE feature_name <> ''""")
def item_features_union(spark, d):
    m = table(spark, d, "content_metadata")
    rows = ft.melt(m, "media_guid", ["media_type"]).unionByName(ft.split_explode(m, "media_guid", "media_genres", "genre_"))
    return rows.withColumnRenamed("media_guid", "item_id").filter("feature_name is not null and feature_name <> ''").distinct()


@query("SELECT event_id, ts, user_id, event_type, value, props FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_row_per_user(spark, d):
    return ft.latest(table(spark, d, "events"), "user_id", "ts", "event_id")


# Weighting.

_EVENT_W = "value * CASE event_type WHEN 'purchase' THEN 5.0 WHEN 'signup' THEN 3.0 WHEN 'click' THEN 0.5 ELSE 1.0 END"


@query(f"WITH {E} SELECT event_id, round({_EVENT_W}, 6) AS value FROM ev")
def event_weighted(spark, d):
    return events(spark, d).select("event_id", F.round(wt.event_weight(F.col("value"), F.col("event_type"), WEIGHTS), 6).alias("value"))


@query(f"WITH {E} SELECT event_id, round(value * exp(-0.01 * days_ago), 6) AS value FROM ev")
def time_decayed(spark, d):
    return events(spark, d).select("event_id", F.round(wt.decay(F.col("value"), F.col("days_ago"), 0.01), 6).alias("value"))


_IPS = "pow(count(*) OVER (PARTITION BY item_id) / (SELECT max(c) FROM (SELECT count(*) AS c FROM {t} GROUP BY item_id))::DOUBLE, 0.5)"


@query(f"WITH {E} SELECT event_id, round(value / {_IPS.format(t='ev')}, 6) AS value FROM ev")
def ips_weighted(spark, d):
    return wt.inverse_propensity(events(spark, d), 0.5).select("event_id", F.round("value", 6).alias("value"))


@query(f"""WITH {E}, w AS (SELECT user_id, item_id, {_EVENT_W} * exp(-0.01 * days_ago) AS value FROM ev WHERE value IS NOT NULL)
SELECT user_id, item_id, round(sum(v), 4) AS value FROM (SELECT user_id, item_id, value / {_IPS.format(t='w')} AS v FROM w) GROUP BY 1, 2""")
def full_weighting(spark, d):
    rows = wt.weigh(events(spark, d), WEIGHTS, 0.01, 0.5)
    return rows.groupBy("user_id", "item_id").agg(F.round(F.sum("value"), 4).alias("value"))


# Mappings and Gram blocks.


@query("SELECT id, row_number() OVER (ORDER BY id) - 1 AS idx FROM (SELECT user_id AS id FROM interactions UNION SELECT user_id FROM user_features) WHERE id IS NOT NULL")
def index_mappings(spark, d):
    return mappings.index((table(spark, d, "interactions"), "user_id"), (table(spark, d, "user_features"), "user_id"))


@query(f"WITH {X} SELECT a.i AS i, b.i AS j, sum(a.v * b.v) AS g FROM x a JOIN x b ON a.u = b.u AND a.i <= b.i GROUP BY 1, 2")
def gram_xtx(spark, d):
    return linear.gram(orders(spark, d), "user_id", "item_id")


@query(f"WITH {T} SELECT a.item_id AS i, b.item_id AS j, sum(a.value * b.value) AS g FROM tf a JOIN tf b ON a.feature_name = b.feature_name AND a.item_id <= b.item_id GROUP BY 1, 2")
def gram_ttt(spark, d):
    return linear.gram(supplier_features(spark, d), "feature_name", "item_id")


@query(f"WITH {X}, {U} SELECT i, feature_name AS j, sum(v * value) AS g FROM x JOIN uf ON u = user_id GROUP BY 1, 2")
def gram_xtu(spark, d):
    return linear.cross_gram(orders(spark, d), "item_id", customer_features(spark, d), "feature_name", "user_id")


@query(f"WITH {U} SELECT a.feature_name AS i, b.feature_name AS j, sum(a.value * b.value) AS g FROM uf a JOIN uf b ON a.user_id = b.user_id AND a.feature_name <= b.feature_name GROUP BY 1, 2")
def gram_utu(spark, d):
    return linear.gram(customer_features(spark, d), "user_id", "feature_name")


# The linear model; the SQL inverts G + lambda I by Gauss-Jordan steps in one recursive table.

_S = f"""WITH RECURSIVE {X},
items AS (SELECT i, row_number() OVER (ORDER BY i) AS k FROM (SELECT DISTINCT i FROM x)),
g AS (SELECT a.i AS li, b.i AS ri, sum(a.v * b.v) AS g FROM x a JOIN x b ON a.u = b.u GROUP BY 1, 2),
full_g AS (SELECT p.k AS r, q.k AS c, coalesce(g.g, 0) + CASE WHEN p.k = q.k THEN {LAMBDA} ELSE 0.0 END AS v
  FROM items p CROSS JOIN items q LEFT JOIN g ON g.li = p.i AND g.ri = q.i),
rowsl AS (SELECT r, list(v ORDER BY c) AS rw FROM full_g GROUP BY r),
gj(k, n, a) AS (
  SELECT 1, (SELECT count(*) FROM items), list(list_concat(rw, list_transform(range(1, (SELECT count(*) FROM items) + 1),
    lambda c: CASE WHEN c = r THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)) ORDER BY r) FROM rowsl
  UNION ALL
  SELECT k + 1, n, list_transform(a, lambda rw, r: CASE WHEN r = k THEN list_transform(rw, lambda z: z / a[k][k])
    ELSE list_transform(rw, lambda z, c: z - rw[k] / a[k][k] * a[k][c]) END) FROM gj WHERE k <= n),
pr AS MATERIALIZED (SELECT n, unnest(range(1, n + 1)) AS r, unnest(list_transform(a, lambda rw: rw[n + 1:])) AS rw FROM gj WHERE k = n + 1),
p AS MATERIALIZED (SELECT r, unnest(range(1, n + 1)) AS c, unnest(rw) AS v FROM pr),
s AS MATERIALIZED (SELECT p.r, p.c, -p.v / d.v AS w FROM p JOIN p d ON d.r = p.c AND d.c = p.c WHERE p.r <> p.c)"""


def _model(spark, d) -> linear.LinearModel:
    return linear.train(orders(spark, d), lam=LAMBDA)


@query(_S + " SELECT a.i AS r, 'i:' || b.i AS c, round(w, 6) AS w FROM s JOIN items a ON a.k = r JOIN items b ON b.k = c")
def ease_weights(spark, d):
    return _model(spark, d).weights.select("r", "c", F.round("w", 6).alias("w"))


@query(_S + """, sc AS (SELECT x.u, s.r, sum(x.v * s.w) AS score FROM x JOIN items it ON it.i = x.i JOIN s ON s.c = it.k GROUP BY 1, 2),
cand AS (SELECT sc.u, it.i, sc.score FROM sc JOIN items it ON it.k = sc.r WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.u = sc.u AND x.i = it.i)),
rk AS (SELECT u, i, round(score, 6) AS score, row_number() OVER (PARTITION BY u ORDER BY round(score, 6) DESC, i) AS rnk FROM cand)
SELECT u AS user_id, CAST(rnk AS INTEGER) AS rank, i AS item_id, score FROM rk WHERE rnk <= 10""")
def ease_topk_warm(spark, d):
    x = orders(spark, d)
    return linear.train(x, lam=LAMBDA).recommend(x, k=10, digits=6)


@query(_S + """, rk AS (SELECT a.i AS item, b.i AS item_id, round(w, 6) AS score, row_number() OVER (PARTITION BY a.i ORDER BY round(w, 6) DESC, b.i) AS rnk
  FROM s JOIN items a ON a.k = c JOIN items b ON b.k = r)
SELECT item, CAST(rnk AS INTEGER) AS rank, item_id, score FROM rk WHERE rnk <= 5""")
def similar_items(spark, d):
    return _model(spark, d).neighbours(5, digits=6)


@query()
def ease_topk_cold(spark, d):
    """Customers by their features alone."""
    u = customer_features(spark, d)
    model = linear.train(orders(spark, d), u, supplier_features(spark, d), lam=LAMBDA)
    return model.recommend(orders(spark, d).limit(0), u, 10, digits=6)


@query()
def ease_tuned(spark, d):
    from veldt.operators import tuning

    trials = tuning.search(orders(spark, d), tuning.grid({"lam": [50.0, 500.0]}), customer_features(spark, d), n_folds=2, k=10)
    rows = [(t.params["lam"], round(t.mean_score, 6), t is tuning.best(trials)) for t in trials]
    return spark.createDataFrame(rows, "lam double, ndcg double, best boolean")


# Splits.

_SHUFFLE = "md5(concat_ws('|', '42', user_id, CAST(event_id AS VARCHAR)))"
_PLACED = f"{E}, placed AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {_SHUFFLE}, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM ev)"


def _labelled(s: splits.Split) -> DataFrame:
    return s.train.select("event_id", F.lit("train").alias("part")).unionByName(s.test.select("event_id", F.lit("test").alias("part")))


@query(f"WITH {_PLACED} SELECT event_id, CASE WHEN n >= 2 AND rn <= least(greatest(round(n * 0.2), 1), n - 1) THEN 'test' ELSE 'train' END AS part FROM placed")
def split_random(spark, d):
    return _labelled(splits.random_split(events(spark, d), 0.2, row=["event_id"]))


@query(f"WITH {_PLACED} SELECT event_id, CASE WHEN rn <= 2 AND n > 2 THEN 'test' ELSE 'train' END AS part FROM placed")
def split_leave_k(spark, d):
    return _labelled(splits.leave_k_out(events(spark, d), 2, row=["event_id"]))


@query(f"WITH {E} SELECT event_id, CASE WHEN days_ago <= 7 THEN 'test' ELSE 'train' END AS part FROM ev")
def split_temporal(spark, d):
    return _labelled(splits.temporal_split(events(spark, d), 7))


@query("""WITH u AS (SELECT user_id, row_number() OVER (ORDER BY md5(concat_ws('|', '42', user_id)), user_id) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM interactions WHERE user_id IS NOT NULL))
SELECT user_id, CAST(CASE WHEN pos < (n % 3) * (n // 3 + 1) THEN pos // (n // 3 + 1) ELSE n % 3 + (pos - (n % 3) * (n // 3 + 1)) // (n // 3) END AS INTEGER) AS fold FROM u""")
def kfold_users(spark, d):
    return splits.user_folds(table(spark, d, "interactions"), 3)


@query(f"WITH {_PLACED} SELECT event_id, CAST((rn - 1) % 3 AS INTEGER) AS fold FROM placed")
def kfold_rows(spark, d):
    return splits.row_folds(events(spark, d), 3, row=["event_id"]).select("event_id", "fold")


# Metrics: what a user used most before the last ten days, against what they used in them.

_RANKED = f"""{E},
ranked AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY sum(value) DESC, item_id) AS rank FROM ev WHERE days_ago > 10 GROUP BY 1, 2),
rel AS (SELECT DISTINCT user_id, item_id FROM ev WHERE days_ago <= 10),
nrel AS (SELECT user_id, count(*) AS n_rel FROM rel GROUP BY 1),
ks AS (SELECT unnest([5, 10]) AS k),
hits AS (SELECT r.user_id, r.rank, row_number() OVER (PARTITION BY r.user_id ORDER BY r.rank) AS h FROM ranked r JOIN rel USING (user_id, item_id) WHERE r.rank <= 10),
m AS (SELECT n.user_id, k, n_rel, count(h.rank) AS c, coalesce(sum(1 / log2(h.rank + 1)), 0) AS dcg, coalesce(sum(h.h / h.rank::DOUBLE), 0) AS ap
  FROM nrel n CROSS JOIN ks LEFT JOIN hits h ON h.user_id = n.user_id AND h.rank <= k GROUP BY 1, 2, 3),
ideal AS (SELECT g AS n, sum(1 / log2(g + 1)) OVER (ORDER BY g) AS idcg FROM (SELECT unnest(range(1, 11)) AS g)),
per_user AS (SELECT user_id, k, c / k::DOUBLE AS p, c / n_rel::DOUBLE AS r, dcg / idcg AS ndcg, ap / n_rel AS map, CASE WHEN c > 0 THEN 1.0 ELSE 0.0 END AS hr
  FROM m JOIN ideal ON n = least(n_rel, k))"""


def _ranked(spark, d) -> tuple[DataFrame, DataFrame]:
    e = events(spark, d)
    scored = e.filter("days_ago > 10").groupBy("user_id", "item_id").agg(F.sum("value").alias("score"))
    return linear.rank_top(scored, 10), e.filter("days_ago <= 10")


@query(f"WITH {_RANKED} SELECT user_id, k, round(p, 6) AS precision, round(r, 6) AS recall, round(ndcg, 6) AS ndcg, round(map, 6) AS map, hr AS hit_rate FROM per_user")
def metrics_per_user(spark, d):
    rows = metrics.per_user_metrics(*_ranked(spark, d), [5, 10])
    return rows.select("user_id", "k", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "ndcg", "map")], "hit_rate")


@query(f"WITH {_RANKED} SELECT k, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(ndcg), 6) AS ndcg, round(avg(map), 6) AS map, round(avg(hr), 6) AS hit_rate FROM per_user GROUP BY k")
def metrics_at_k(spark, d):
    rows = metrics.mean_metrics(metrics.per_user_metrics(*_ranked(spark, d), [5, 10]))
    return rows.select("k", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "ndcg", "map", "hit_rate")])


@query(f"WITH {_RANKED} SELECT round(count(DISTINCT item_id) / 100.0::DOUBLE, 6) AS coverage FROM ranked WHERE rank <= 10")
def coverage(spark, d):
    return metrics.catalogue_coverage(_ranked(spark, d)[0], 10, 100).select(F.round("coverage", 6).alias("coverage"))


@query()
def evaluate_ease(spark, d):
    x = orders(spark, d).groupBy("user_id", "item_id").agg(F.sum("value").alias("value"))
    s = splits.random_split(x, 0.2, row=["item_id"])
    report, _ = metrics.evaluate(linear.train(s.train, lam=LAMBDA), s.train, s.test, ks=(5, 10))
    return report.select("k", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "ndcg", "map", "hit_rate")])


# Affinity, penalties, sequences, pairs.

_AFF = """pairs AS (SELECT user_id, item_id, count(*) AS n FROM interactions GROUP BY 1, 2),
aff AS (SELECT user_id, sum(n) AS events, sum(n - 1) AS repeats FROM pairs GROUP BY 1),
pg AS (SELECT sum(repeats) / sum(events) AS p FROM aff)"""


@query(f"WITH {_AFF} SELECT user_id, CAST(events AS BIGINT) AS events, CAST(repeats AS BIGINT) AS repeats, round(1 - (repeats + 10 * p) / (events + 10), 6) AS rho FROM aff, pg")
def repeat_affinity(spark, d):
    return affinity.repeat_affinity(table(spark, d, "interactions")).withColumn("rho", F.round("rho", 6))


@query(f"""WITH {E}, sc AS (SELECT user_id, item_id, sum(value) AS score FROM ev GROUP BY 1, 2),
seen AS (SELECT DISTINCT user_id, item_id FROM ev WHERE days_ago <= 5),
pen AS (SELECT sc.user_id, sc.item_id, round(score - CASE WHEN seen.item_id IS NULL THEN 0 ELSE 5.0 END, 6) AS score FROM sc LEFT JOIN seen USING (user_id, item_id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS r FROM pen)
SELECT user_id, CAST(r AS INTEGER) AS rank, item_id, score FROM rk WHERE r <= 10""")
def penalised_topk(spark, d):
    e = events(spark, d)
    scored = linear.penalised(e.groupBy("user_id", "item_id").agg(F.sum("value").alias("score")), e.filter("days_ago <= 5"), 5.0)
    return linear.rank_top(scored.withColumn("score", F.round("score", 6)), 10)


_TOKENS = f"""{E}, toks AS (SELECT id, row_number() OVER (ORDER BY id) AS token FROM (SELECT DISTINCT item_id AS id FROM ev)),
hist AS (SELECT user_id, token, row_number() OVER (PARTITION BY user_id ORDER BY days_ago, event_id DESC) AS r FROM ev JOIN toks ON id = item_id)"""


@query(f"""WITH {_TOKENS}, h AS (SELECT user_id, list(token ORDER BY r DESC) AS h FROM hist WHERE r <= 11 GROUP BY 1 HAVING count(*) >= 2)
SELECT user_id, list_concat(list_transform(range(10 - (len(h) - 1)), lambda z: 0::BIGINT), h[1:len(h) - 1]) AS input,
  list_concat(list_transform(range(10 - (len(h) - 1)), lambda z: 0::BIGINT), h[2:]) AS target FROM h""")
def sequences_padded(spark, d):
    e = events(spark, d)
    return sequences.padded_sequences(e, mappings.index((e, "item_id")), 10, ties=("event_id",))


@query(f"WITH {E} SELECT * FROM (SELECT user_id, item_id, lead(item_id) OVER (PARTITION BY user_id ORDER BY days_ago DESC, event_id) AS next_item_id FROM ev) WHERE next_item_id IS NOT NULL")
def next_item_pairs(spark, d):
    return sequences.next_items(events(spark, d), ties=("event_id",))


@query("""WITH pos AS (SELECT user_id, item_id FROM interactions WHERE user_id IS NOT NULL AND item_id IS NOT NULL AND coalesce(value, 0) > 0)
SELECT dense_rank() OVER (ORDER BY user_id) AS user_idx, dense_rank() OVER (ORDER BY item_id) - 1 AS item_idx FROM pos""")
def positive_pairs(spark, d):
    return sequences.positive_pairs(table(spark, d, "interactions"))[0]


@query("SELECT coalesce(feature_name, '') AS feature_name, bool_and(abs(coalesce(value, 0) - 1) <= 2.220446049250313e-16) AS categorical FROM user_features GROUP BY 1")
def feature_kind_split(spark, d):
    return sequences.feature_kinds(table(spark, d, "user_features"))


@query("""WITH kinds AS (SELECT feature_name, bool_and(abs(coalesce(value, 0) - 1) <= 2.220446049250313e-16) AS categorical FROM item_features GROUP BY 1),
slots AS (SELECT *, row_number() OVER (PARTITION BY categorical ORDER BY feature_name) - 1 AS slot FROM kinds),
ents AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS idx FROM (SELECT DISTINCT item_id AS id FROM interactions WHERE item_id IS NOT NULL)),
cells AS (SELECT idx, categorical, slot FROM item_features f JOIN ents ON id = item_id JOIN slots ON slots.feature_name = f.feature_name GROUP BY 1, 2, 3)
SELECT idx AS entity_idx, count(*) FILTER (categorical) AS n_cat, coalesce(sum(slot) FILTER (categorical), 0)::BIGINT AS cat_sum FROM cells GROUP BY 1""")
def feature_slots(spark, d):
    items = mappings.index((table(spark, d, "interactions"), "item_id"))
    t, _ = sequences.feature_table(table(spark, d, "item_features"), "item_id", items)
    return t.select("entity_idx", F.size("cat").cast("bigint").alias("n_cat"), F.aggregate("cat", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("cat_sum"))


# Vectors: every hundredth vector asks all of them.


def _vectors(spark, d) -> tuple[DataFrame, DataFrame]:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return v.filter("id % 100 = 0"), v


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


_V = """q AS (SELECT vec_id, list_transform(embedding, lambda z: z::DOUBLE) AS v FROM embeddings WHERE vec_id % 100 = 0), b AS (SELECT vec_id, list_transform(embedding, lambda z: z::DOUBLE) AS v FROM embeddings)"""


@query(f"""WITH {_V}, s AS (SELECT q.vec_id AS query_id, b.vec_id AS item_id, round(list_dot_product(q.v, b.v), 9) AS score FROM q, b)
SELECT query_id, CAST(r AS INTEGER) AS rank, item_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS r FROM s) WHERE r <= 10""")
def knn_exact_dot(spark, d):
    return _rounded(ann.top_k(*_vectors(spark, d), 10))


@query(f"""WITH {_V}, s AS (SELECT q.vec_id AS query_id, b.vec_id AS item_id, round(list_cosine_similarity(q.v, b.v), 9) AS score FROM q, b WHERE q.vec_id <> b.vec_id)
SELECT query_id, CAST(r AS INTEGER) AS rank, item_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS r FROM s) WHERE r <= 10""")
def knn_cosine(spark, d):
    return _rounded(ann.top_k(*_vectors(spark, d), 10, cosine=True, exclude_self=True))


@query()
def knn_codes(spark, d):
    return _rounded(ann.top_k(*_vectors(spark, d), 10, cosine=True, codes=True))


@query()
def knn_hyperplanes(spark, d):
    return _rounded(ann.hyperplane_top_k(*_vectors(spark, d), 10, dim=64))


# Quality, territories, streams.


@query("""WITH c AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*)::DOUBLE AS n FROM events GROUP BY 1, 2),
l AS (SELECT event_type, max(day) AS d FROM c GROUP BY 1),
o AS (SELECT c.event_type, count(*) AS n, avg(c.n) AS mean, stddev_samp(c.n) AS std FROM c JOIN l ON l.event_type = c.event_type AND day < d GROUP BY 1)
SELECT o.event_type, o.n, round(mean, 6) AS mean, round(std, 6) AS std, c.n AS current, round(CASE WHEN std > 0 THEN abs(c.n - mean) / std ELSE 0 END, 6) AS z_score,
  c.n BETWEEN mean - 5 * std AND mean + 5 * std AS passed FROM o JOIN l USING (event_type) JOIN c ON c.event_type = o.event_type AND day = d WHERE o.n >= 2""")
def quality_gate(spark, d):
    counts = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).cast("double").alias("v"))
    rows = quality.gate(counts, "event_type", "v", "day")
    return rows.select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "current", F.round("z_score", 6).alias("z_score"), "passed")


@query("""WITH t AS (SELECT CAST(c_custkey AS VARCHAR) AS user_id, r_name AS territory FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
x AS (SELECT CAST(o_custkey AS VARCHAR) AS user_id, CAST(l_suppkey AS VARCHAR) AS item_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
c AS (SELECT coalesce(territory, 'global') AS territory, item_id, count(*)::DOUBLE AS score FROM x LEFT JOIN t USING (user_id) GROUP BY 1, 2),
b AS (SELECT * FROM c WHERE territory <> 'global' UNION ALL SELECT 'global', item_id, sum(score) FROM c GROUP BY 2)
SELECT territory, CAST(r AS INTEGER) AS rank, item_id, score FROM (SELECT *, row_number() OVER (PARTITION BY territory ORDER BY score DESC, item_id) AS r FROM b) WHERE r <= 10""")
def territory_topk(spark, d):
    r = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return recommenders.territory_top(orders(spark, d), r.select(F.col("c_custkey").cast("string").alias("user_id"), F.col("r_name").alias("territory")))


@query("""SELECT date_trunc('day', loaded_at) AS window_start, item_id, count(*) AS n, sum(value) AS total FROM interactions
WHERE regexp_matches(user_id, '[^\\s\\p{Z}\\x{1c}-\\x{1f}\\x{85}\\x{0b}]') AND regexp_matches(item_id, '[^\\s\\p{Z}\\x{1c}-\\x{1f}\\x{85}\\x{0b}]') AND value IS NOT NULL AND NOT isnan(value) AND NOT isinf(value) GROUP BY 1, 2""")
def windowed_item_scores(spark, d):
    return windowed_scores(table(spark, d, "interactions"))
