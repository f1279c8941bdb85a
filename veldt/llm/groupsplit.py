"""Train, validation and test splits that keep linked records together.

Groups are connected components of id links. They are bundled by their counts of each label; a min-cost flow sends each
label's records to the splits so that the quotas are met, overall and per label, at the least deviation; the flow is
rounded to whole components by the labels they hold, and the members of a bundle are dealt out by the order of their hashes.
"""

from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veldt.functions.text import blank, strip
from veldt.session import col, cut, hint, release, spread_join

SPLITS = ("train", "validation", "test")
#: Component sizes above this are bundled by hundredths of their magnitude, so that bundles stay few at any scale.
EXACT_SIZES = 4096
#: Labels beyond the most frequent ones count as one label.
LABELS = 64
#: Label profiles (counts of each label) that have a bundle of their own, the most frequent ones; components of other
#: profiles are bundled by size and dominant label, and the bundle's counts of all labels are charged.
PROFILES = 16384
#: Hash classes in which the members of a bundle are counted before they are ranked.
DEAL = 1024


def node(c: Column) -> Column:
    """An id as links compare it: without regard to case and surrounding blanks."""
    return F.lower(strip(c.cast("string")))


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """node, comp: the least node of its component for every node of a link with two different, non-blank ends.

    Minimum labels spread over links and are then followed as pointers, so the rounds grow with the logarithm of the
    longest chain in practice; each round is written, and its aggregates combine before they shuffle. Repeated links, either direction and
    links of a node with itself change nothing; an empty table gives no row.
    """
    ends = links.select(node(col(left)).alias("a"), node(col(right)).alias("b")).filter(~blank(F.col("a")) & ~blank(F.col("b")) & (F.col("a") != F.col("b")))
    edges = cut(ends.union(ends.select("b", "a")).distinct())
    label = cut(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("l")))
    while True:
        near = spread_join(edges, label.select(F.col("v").alias("b"), "l"), "b", "a").groupBy("a").agg(F.min("l").alias("m"))
        step = label.join(near, label["v"] == near["a"], "left").select("v", F.col("l").alias("was"), F.least("l", F.coalesce("m", "l")).alias("l"))
        step = cut(step)
        up = step.select(F.col("v").alias("l"), F.col("l").alias("up"))
        # All nodes of a component come to share a label, so its rows are spread.
        jumped = cut(spread_join(step, up, "l", "v", "left").select("v", "was", F.least("l", F.coalesce("up", "l")).alias("l")))
        still = jumped.filter("l <> was").isEmpty()
        release(step, label)
        label = jumped.select("v", "l")
        label._veldt_path = jumped._veldt_path
        if still:
            release(edges)
            return label.select(F.col("v").alias("node"), F.col("l").alias("comp"))


def min_cost_flow(n: int, arcs: list[tuple[int, int, int, int]], source: int, sink: int, amount: int) -> list[int]:
    """The flow on each arc (from, to, capacity, cost >= 0) of a cheapest flow of the amount, or of as much as fits."""
    to, cap, cost, out = [], [], [], [[] for _ in range(n)]
    for u, v, c, w in arcs:
        for x, y, k, z in ((u, v, c, w), (v, u, 0, -w)):
            out[x].append(len(to))
            to.append(y)
            cap.append(k)
            cost.append(z)
    while amount > 0:
        best, via, queue, queued = [None] * n, [-1] * n, deque([source]), [False] * n
        best[source] = 0
        while queue:
            u = queue.popleft()
            queued[u] = False
            for e in out[u]:
                if cap[e] > 0 and (best[to[e]] is None or best[u] + cost[e] < best[to[e]]):
                    best[to[e]], via[to[e]] = best[u] + cost[e], e
                    if not queued[to[e]]:
                        queue.append(to[e])
                        queued[to[e]] = True
        if best[sink] is None:
            break
        path, v = [], sink
        while v != source:
            path.append(via[v])
            v = to[via[v] ^ 1]
        push = min([amount, *(cap[e] for e in path)])
        for e in path:
            cap[e] -= push
            cap[e ^ 1] += push
        amount -= push
    return [cap[2 * k + 1] for k in range(len(arcs))]


def allocate(bundles: list[tuple[str, int, int, int]], shares: tuple[float, ...], counts: list[dict] | None = None) -> list[list[int]]:
    """Components per split for each bundle (profile, size, components, records).

    counts has each bundle's records by label; without it, the profile is the label of all of them. Records of one label
    can stand for each other in the flow, so the network has a node per label and per label and split; arcs cost nothing
    up to the quota and, beyond it, one per record within a label and four overall. The flow is rounded to whole
    components from the largest size down: each bundle is spread as its labels are still lacking, and what is left over
    takes the split where it lowers the same costs most, then the split that got least of such before.
    """
    counts = [{b[0]: b[3]} for b in bundles] if counts is None else counts
    labels = sorted({x for c in counts for x in c})
    supply = dict.fromkeys(labels, 0)
    for c in counts:
        for x, n in c.items():
            supply[x] += n
    total, k = sum(supply.values()), len(shares)
    split0 = 1 + len(labels)
    mid0, sink = split0 + k, split0 + k + len(labels) * k
    arcs = [(0, 1 + i, supply[x], 0) for i, x in enumerate(labels)]
    at = {}
    for i, x in enumerate(labels):
        for s in range(k):
            at[x, s] = len(arcs)
            arcs.append((1 + i, mid0 + i * k + s, supply[x], 0))
            quota = round(supply[x] * shares[s])
            arcs += [(mid0 + i * k + s, split0 + s, quota, 0), (mid0 + i * k + s, split0 + s, supply[x], 1)]
    for s in range(k):
        arcs += [(split0 + s, sink, round(total * shares[s]), 0), (split0 + s, sink, total, 4)]
    flow = min_cost_flow(sink + 1, arcs, 0, sink, total)
    lack = {x: [flow[at[x, s]] for s in range(k)] for x in labels}
    whole = [sum(lack[x][s] for x in labels) for s in range(k)]
    carry, out = [0.0] * k, {}
    for i, (_, size, count, records) in sorted(enumerate(bundles), key=lambda b: (-b[1][1], b[1][0])):
        each, want = {x: n / max(count, 1) for x, n in counts[i].items()}, [0.0] * k
        for x, n in counts[i].items():
            open_ = sum(max(r, 0) for r in lack[x])
            for s in range(k):
                want[s] += count * n / max(records, 1) * (max(lack[x][s], 0) / open_ if open_ > 0 else shares[s])
        got = [0] * k

        def give(s: int, n: int) -> None:
            got[s] += n
            for x, m in each.items():
                lack[x][s] -= n * m
                whole[s] -= n * m

        def gain(s: int) -> float:
            m = sum(each.values())
            return sum(abs(lack[x][s]) - abs(lack[x][s] - m) for x, m in each.items()) + 4 * (abs(whole[s]) - abs(whole[s] - m))

        for s in range(k):
            give(s, min(int(want[s]), count - sum(got)))
        while sum(got) < count:
            give(max(range(k), key=lambda s: (round(gain(s), 6), carry[s] + want[s] - got[s], -s)), 1)
        carry = [c + w - g for c, w, g in zip(carry, want, got)]
        out[i] = got
    return [out[i] for i in range(len(bundles))]


def group_split(records: DataFrame, user: str, links: DataFrame, left: str, right: str, label: str, shares: tuple[float, ...] = (0.8, 0.1, 0.1)) -> DataFrame:
    """user, comp, linked, n, split: one row for each non-blank user id of the records, as written there.

    All ids of a component, however long the chain of links and whether or not the ids between have records, get the
    same split. n counts the user's rows as delivered; null labels are a label of their own; rows with a blank user
    belong to nobody and get no row here (see record_split). Ids without links are components of one. An empty table
    gives no row. Other columns are ignored. The result does not depend on the order or partitioning of the rows.
    """
    counts = records.select(col(user).cast("string").alias("u"), F.coalesce(col(label).cast("string"), F.lit("")).alias("x")).filter(~blank(F.col("u")))
    counts = counts.groupBy("u", "x").agg(F.count(F.lit(1)).alias("n")).withColumn("node", node(F.col("u")))
    comps = components(links, left, right)
    counts = cut(counts.join(hint(comps), "node", "left").withColumn("linked", F.col("comp").isNotNull()).withColumn("comp", F.coalesce("comp", "node")))
    common = [r["x"] for r in counts.groupBy("x").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "x").limit(LABELS).collect()]
    label_at = F.array_position(F.array(*[F.lit(x) for x in common or [""]]), F.col("x")).cast("int")  # 0: beyond the most frequent
    per_label = counts.groupBy("comp", label_at.alias("i")).agg(F.sum("n").alias("n"))
    whole = per_label.groupBy("comp").agg(F.sum("n").alias("size"), F.max(F.struct("n", "i"))["i"].alias("most"), F.sort_array(F.collect_list(F.struct("i", "n"))).alias("labels"))
    exact = F.concat_ws(" ", F.transform("labels", lambda z: F.concat_ws(":", z["i"].cast("string"), z["n"].cast("string"))))
    coarse = F.floor(F.pow(F.lit(10.0), F.floor(F.log10("size") * 100) / 100)).cast("bigint")
    whole = whole.withColumn("exact", exact).withColumn("bundle", F.when(F.col("size") <= EXACT_SIZES, F.col("size")).otherwise(coarse)).withColumn("h", F.xxhash64("comp")).withColumn("deal", F.pmod("h", F.lit(DEAL)).cast("int"))
    kept = whole.groupBy("exact").agg(F.count(F.lit(1)).alias("c")).orderBy(F.col("c").desc(), "exact").limit(PROFILES).select("exact", F.col("exact").alias("profile"))
    whole = cut(whole.join(F.broadcast(kept), "exact", "left").withColumn("profile", F.coalesce("profile", F.concat(F.lit("most "), F.col("most").cast("string")))).drop("exact", "most"))
    dealt = cut(whole.groupBy("profile", "bundle", "deal").agg(F.count(F.lit(1)).alias("c"), F.sum("size").alias("r")))
    by_label = whole.select("profile", "bundle", F.explode("labels").alias("z")).groupBy("profile", "bundle", "z.i").agg(F.sum("z.n").alias("n"))
    by_label = by_label.groupBy("profile", "bundle").agg(F.collect_list(F.struct("i", "n")).alias("labels"))
    sums = dealt.groupBy("profile", "bundle").agg(F.sum("c").alias("c"), F.sum("r").alias("r")).join(by_label, ["profile", "bundle"]).orderBy("profile", "bundle").collect()
    bundles = [(r["profile"], r["bundle"], r["c"], r["r"]) for r in sums]
    labels = [dict(sorted((z["i"], z["n"]) for z in r["labels"])) for r in sums]
    if not bundles:
        return counts.select(F.col("u").alias(user), "comp", "linked", "n", F.lit("train").alias("split"))
    plan = [(b[0], b[1], *[int(x) for x in got]) for b, got in zip(bundles, allocate(bundles, shares, labels))]
    quota = records.sparkSession.createDataFrame(plan, "profile string, bundle bigint, " + ", ".join(f"c{s} bigint" for s in range(len(shares))))
    before = F.sum("c").over(W.partitionBy("profile", "bundle").orderBy("deal").rowsBetween(W.unboundedPreceding, -1))
    offsets = dealt.withColumn("before", F.coalesce(before, F.lit(0))).join(F.broadcast(quota), ["profile", "bundle"])
    rank = F.row_number().over(W.partitionBy("profile", "bundle", "deal").orderBy("h", "comp")) + F.col("before")
    split, upto = F.lit(SPLITS[len(shares) - 1]), None
    edges = [sum((F.col(f"c{j}") for j in range(s + 1)), F.lit(0)) for s in range(len(shares))]
    for s in reversed(range(len(shares) - 1)):
        split = F.when(F.col("at") <= edges[s], F.lit(SPLITS[s])).otherwise(split)
    placed = whole.join(offsets.drop("c", "r"), ["profile", "bundle", "deal"]).withColumn("at", rank).select("comp", split.alias("split"))
    users = counts.groupBy("u", "comp", "linked").agg(F.sum("n").alias("n")).join(placed, "comp")
    return users.select(F.col("u").alias(user), "comp", "linked", "n", "split")


def linked_pairs(users: DataFrame, user: str) -> DataFrame:
    """user_a < user_b: the pairs of ids of one component that has links, all in one split."""
    mine = cut(users.filter("linked").select(col(user).alias("u"), "comp", "split").distinct())
    other = mine.select(F.col("u").alias("user_b"), "comp", F.col("split").alias("s"))
    return mine.select(F.col("u").alias("user_a"), "comp", "split").join(other, "comp").filter("user_a < user_b and split = s").select("user_a", "user_b")


def record_split(records: DataFrame, user: str, users: DataFrame, shares: tuple[float, ...] = (0.8, 0.1, 0.1)) -> DataFrame:
    """All records with a column split; rows with a blank user go by the hash of their columns, in the same shares."""
    place = users.select(F.col(user).alias("__u"), F.col("split").alias("__s"))
    h = F.pmod(F.xxhash64(*[col(c) for c in records.columns]), F.lit(1_000_000)) / 1_000_000
    own, upto = F.lit(SPLITS[len(shares) - 1]), 0.0
    for s in reversed(range(len(shares) - 1)):
        own = F.when(h < sum(shares[: s + 1]), F.lit(SPLITS[s])).otherwise(own)
    return records.join(hint(place), col(user).cast("string") == F.col("__u"), "left").withColumn("split", F.coalesce("__s", own)).drop("__u", "__s")
