"""The queries of the llm operators and the SQL that some of them are checked against."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt.llm.bpe import encode_corpus
from veldt.llm.groupsplit import group_split, linked_pairs, record_split
from veldt.llm.knn import nearest, neighbour_pairs
from veldt.llm.langid import language_segments, relabelled
from veldt.llm.leaks import leaked_passages
from veldt.llm.pairs import pair_association
from veldt.llm.topn import top_n
from veldt.session import table
from veldt.sources.records import usable_interactions


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    scores = usable_interactions(table(spark, d, "interactions")).groupBy("user_id", "item_id").agg(F.sum("value").alias("score"))
    return top_n(scores, "user_id", "item_id", "score", 5)


def _pairs(spark: SparkSession, d: str, min_lift: float) -> DataFrame:
    rows = usable_interactions(table(spark, d, "interactions"), positive=True)
    return pair_association(rows, "user_id", "item_id", 10, min_lift)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d, 4.0).select("item_a", "item_b")


def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    cols = [F.round(c, 6).alias(c) for c in ("lift", "odds_ratio", "log_odds")]
    return _pairs(spark, d, 0.0).select("item_a", "item_b", "n_a", "n_b", "n_ab", "n_baskets", *cols)


def _nearest(spark: SparkSession, d: str):
    for name, key in (("item_matrix", "item_guid"), ("id_embedding", "user_id")):
        df = table(spark, d, name)
        yield name, nearest(df.filter(F.col(key) != "<COLD_START>"), key, name)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    (a, x), (b, y) = [(n, neighbour_pairs(near)) for n, near in _nearest(spark, d)]
    return x.select(F.lit(a).alias("matrix_name"), "id_a", "id_b").union(y.select(F.lit(b), "id_a", "id_b"))


def p5_neighbours(spark: SparkSession, d: str) -> DataFrame:
    (a, x), (b, y) = [(n, near.select("id", F.posexplode("ids").alias("pos", "neighbour"))) for n, near in _nearest(spark, d)]
    both = x.withColumn("matrix_name", F.lit(a)).unionByName(y.withColumn("matrix_name", F.lit(b)))
    return both.select("matrix_name", "id", (F.col("pos") + 1).alias("nth"), "neighbour")


def _users(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "interactions")
    return rows, group_split(rows, "user_id", table(spark, d, "account_links"), "user_id", "linked_id", "event_type")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return linked_pairs(_users(spark, d)[1], "user_id")


def p7_user_splits(spark: SparkSession, d: str) -> DataFrame:
    return _users(spark, d)[1].select("user_id", "comp", "n", "split")


def p7_split_stats(spark: SparkSession, d: str) -> DataFrame:
    """The counts of split_stats for this split: one row, over all records as delivered."""
    rows, users = _users(spark, d)
    n = record_split(rows, "user_id", users).groupBy("split").agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("interactions"))
    u = users.groupBy("split").agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("users"))
    both = n.unionByName(u)
    cell = lambda s, w: F.coalesce(F.sum(F.when((F.col("split") == s) & (F.col("what") == w), F.col("n"))), F.lit(0))
    return both.agg(*[cell(s, w).alias(f"{s}_{w}") for w in ("interactions", "users") for s in ("train", "validation", "test")])


def p7_whole(spark: SparkSession, d: str) -> DataFrame:
    """One row: users, records and components of the split, and how many components lie in more than one set."""
    users = _users(spark, d)[1]
    comps = users.groupBy("comp").agg(F.countDistinct("split").alias("splits"), F.count(F.lit(1)).alias("users"), F.sum("n").alias("records"))
    return comps.agg(F.sum("users").alias("users"), F.sum("records").alias("records"), F.count(F.lit(1)).alias("components"), F.count(F.when(F.col("splits") > 1, 1)).alias("torn"))


def p7_quotas(spark: SparkSession, d: str) -> DataFrame:
    """For every label and set the records that a share of exactly 80, 10 or 10 % would be, and whether the split comes as
    near as 1 % of the label's records and ten more."""
    rows, users = _users(spark, d)
    placed = rows.join(users.select(F.col("user_id").alias("u"), "split"), F.col("user_id") == F.col("u")).select(F.coalesce("event_type", F.lit("")).alias("label"), "split")
    n = placed.groupBy("label", "split").agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("label").agg(F.sum("n").alias("total"))
    shares = F.explode(F.array(*[F.struct(F.lit(s).alias("split"), F.lit(x).alias("share")) for s, x in (("train", 0.8), ("validation", 0.1), ("test", 0.1))]))
    want = total.select("label", "total", shares.alias("s")).select("label", "s.split", (F.col("total") * F.col("s.share")).alias("quota"), "total")
    near = F.abs(F.coalesce("n", F.lit(0)) - F.col("quota")) <= 0.01 * F.col("total") + 10
    return want.join(n, ["label", "split"], "left").select("label", "split", F.round("quota", 3).alias("quota"), near.alias("near"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"), "doc_id", "text")


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "eval_items")
    found = leaked_passages(table(spark, d, "documents"), "doc_id", "text", items.select(F.col("eval_id"), F.col("text").alias("item_text")), "eval_id", "item_text", run=80, budget=1)
    return found


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).filter("run >= 80").select("doc_id", "eval_id")


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d)


def p9_one_edit(spark: SparkSession, d: str) -> DataFrame:
    """The first 60 letters and signs of every item with one of them changed: found by edit distance alone."""
    items = table(spark, d, "eval_items").select("eval_id", F.col("text").alias("item_text"))
    plain = items.select(F.col("eval_id").alias("doc_id"), F.regexp_replace(F.lower("item_text"), r"[^\p{L}\p{N}]+", "").alias("f")).filter(F.length("f") >= 60)
    docs = plain.select("doc_id", F.concat(F.substring("f", 1, 35), F.lit("৩"), F.substring("f", 37, 24)).alias("text"))
    return leaked_passages(docs, "doc_id", "text", items, "eval_id", "item_text").filter("doc_id = eval_id").select("eval_id", "errors", "run")


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return language_segments(table(spark, d, "documents"), "doc_id", "text", "lang")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return relabelled(_segments(spark, d), "doc_id")


def p10_segments(spark: SparkSession, d: str) -> DataFrame:
    return _segments(spark, d).select("doc_id", "seg_no", "lang", F.round("confidence", 3).alias("confidence"), "n_sentences")


QUERIES = {f.__name__: f for f in (p1_found, p3_found, p3_pairs, p5_found, p5_neighbours, p7_found, p7_user_splits, p7_split_stats, p7_whole, p7_quotas, p8_ids, p9_found, p9_leaks, p9_one_edit, p10_found, p10_segments)}

_USABLE = """
usable AS (
  SELECT DISTINCT user_id, item_id, value, event_type, days_ago FROM interactions
  WHERE regexp_matches(user_id, '[^\\s\\p{Z}\\x{1c}-\\x{1f}\\x{85}\\x{0b}]') AND regexp_matches(item_id, '[^\\s\\p{Z}\\x{1c}-\\x{1f}\\x{85}\\x{0b}]')
    AND value IS NOT NULL AND NOT isnan(value) AND NOT isinf(value))"""

_PAIRS = f"""
WITH {_USABLE},
baskets AS (SELECT DISTINCT user_id, item_id FROM usable WHERE value > 0),
n AS (SELECT item_id, count(*) AS n FROM baskets GROUP BY 1),
total AS (SELECT count(DISTINCT user_id) AS n_baskets FROM baskets),
pairs AS (
  SELECT a.item_id AS item_a, b.item_id AS item_b, count(*) AS n_ab
  FROM baskets a JOIN baskets b ON a.user_id = b.user_id AND a.item_id < b.item_id GROUP BY 1, 2 HAVING count(*) >= 10),
full_pairs AS (
  SELECT item_a, item_b, x.n AS n_a, y.n AS n_b, n_ab, n_baskets FROM pairs, total, n x, n y
  WHERE x.item_id = item_a AND y.item_id = item_b),
odds AS (
  SELECT *, n_ab * n_baskets / (n_a * n_b)::DOUBLE AS lift0,
    (n_ab + 0.5) * (n_baskets - n_a - n_b + n_ab + 0.5) / ((n_a - n_ab + 0.5) * (n_b - n_ab + 0.5)) AS odds0 FROM full_pairs)
"""

_ROOTS = """
RECURSIVE ends AS (
  SELECT lower(trim(user_id)) AS a, lower(trim(linked_id)) AS b FROM account_links
  WHERE trim(coalesce(user_id, '')) <> '' AND trim(coalesce(linked_id, '')) <> ''),
edges AS (SELECT a, b FROM ends UNION SELECT b, a FROM ends),
reach(v, w) AS (SELECT a, a FROM edges UNION SELECT r.v, e.b FROM reach r JOIN edges e ON e.a = r.w),
comp AS (SELECT v, min(w) AS c FROM reach GROUP BY v)"""

ORACLES = {
    "p1_found": f"""
WITH {_USABLE},
scores AS (SELECT user_id, item_id, sum(value) AS s FROM usable GROUP BY 1, 2)
SELECT user_id, CAST(r AS INTEGER) AS item_rank, item_id FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, item_id) AS r FROM scores) WHERE r <= 5""",
    "p3_found": _PAIRS + "SELECT item_a, item_b FROM odds WHERE n_ab * n_baskets >= 4 * n_a * n_b",
    "p3_pairs": _PAIRS + "SELECT item_a, item_b, n_a, n_b, n_ab, n_baskets, round(lift0, 6) AS lift, round(odds0, 6) AS odds_ratio, round(ln(odds0), 6) AS log_odds FROM odds",
    "p9_one_edit": r"SELECT eval_id, 1 AS errors, 0 AS run FROM eval_items WHERE length(regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g')) >= 60",
    "p7_found": f"""
WITH {_ROOTS},
users AS (SELECT DISTINCT user_id, c FROM interactions JOIN comp ON v = lower(trim(user_id)))
SELECT a.user_id AS user_a, b.user_id AS user_b FROM users a JOIN users b ON a.c = b.c AND a.user_id < b.user_id""",
    "p7_whole": f"""
WITH {_ROOTS},
users AS (SELECT user_id, count(*) AS n, lower(trim(user_id)) AS node FROM interactions WHERE regexp_matches(user_id, '[^\\s\\p{{Z}}\\x{{1c}}-\\x{{1f}}\\x{{85}}\\x{{0b}}]') GROUP BY 1)
SELECT count(*) AS users, CAST(sum(n) AS BIGINT) AS records, count(DISTINCT coalesce(c, node)) AS components, CAST(0 AS BIGINT) AS torn FROM users LEFT JOIN comp ON v = node""",
    "p7_quotas": """
WITH n AS (SELECT coalesce(event_type, '') AS label, count(*) AS n FROM interactions WHERE regexp_matches(user_id, '[^\\s\\p{Z}\\x{1c}-\\x{1f}\\x{85}\\x{0b}]') GROUP BY 1)
SELECT label, split, round(n * share, 3) AS quota, true AS near FROM n, (VALUES ('train', 0.8::DOUBLE), ('validation', 0.1), ('test', 0.1)) AS t(split, share)""",
}
