"""Splits that keep related records together: components by hash-to-min, splits by weighted rendezvous hashing.

A component is what source links and shared objects connect. In every round each node sends its neighbour cluster to
the smallest node in it, and that smallest node to all members, until nothing changes. Clusters are kept as rows
(node, member), never as one value, so a component of a third of all rows is as spread out as any other data. The number
of rounds grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimento.functions import reading
from sedimento.operators.ranking import HOT_ROWS, attach, copied, hot_keys, salted
from sedimento.session import cut, release

MAX_SPLITS = 1000
GIANT = 200  # a group with more than a GIANT-th of all samples is placed by its size: fewer than GIANT groups
CLOSE = 0.002  # shares this near their targets need no further correction
CORRECTIONS = 10


def components(links: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """a, b (longs, undirected) -> node, component (the smallest node of the component).

    Null ends are ignored, repeated links and self-links count once, an empty input gives an empty result.
    """
    both = links.where("a is not null and b is not null and a <> b").select(F.col("a").alias("v"), F.col("b").alias("u"))
    pairs = cut(both.unionByName(both.select(F.col("u").alias("v"), F.col("v").alias("u"))).distinct())
    while True:
        low = cut(pairs.groupBy("v").agg(F.least("v", F.min("u")).alias("m"), F.count("*").alias("n")))
        joined = attach(pairs, low, "v", "u", hot_rows, counted="n")
        if not joined.where("v <> m and u <> m").limit(1).count():
            return low.select(F.col("v").alias("node"), F.col("m").alias("component"))
        old = pairs
        up = joined.select(F.explode(F.array(F.struct(F.col("m").alias("v"), "u"), F.struct(F.col("u").alias("v"), F.col("m").alias("u")), F.struct("v", F.col("m").alias("u")), F.struct(F.col("m").alias("v"), F.col("v").alias("u")))).alias("x"))
        pairs = cut(up.select("x.v", "x.u").where("v <> u").distinct())
        release(old, low)


def facts(samples: DataFrame) -> DataFrame:
    """id, source, codes, split of every sample: the source sample it names, the codes of the objects it shows, its recorded split."""
    l = reading.labels(F.col("labels_json"))
    x = samples.where("id is not null").select("id", F.col("source_sample_id").alias("source"), l.alias("l"), reading.fields(F.col("metadata_json")).alias("m"))
    return x.select("id", "source", reading.object_codes(F.col("l")).alias("codes"), reading.recorded_split(F.col("l"), F.col("m")).alias("split"))


def relations(known: DataFrame) -> DataFrame:
    """a, b: sample to the source sample it names, if that exists, and sample to the code of each object it shows.

    known: as from facts. Codes are negative numbers, so they are nodes of their own: a code with a third of all samples
    needs no pairs.
    """
    ids = known.select(F.col("id").alias("b")).distinct()
    named = known.where("source is not null").select(F.col("id").alias("a"), F.col("source").alias("b"))
    hot = hot_keys(named, ["b"])
    named = salted(named, hot, ["b"], "a").join(copied(ids, hot, ["b"]), ["b", "salt__"], "left_semi").select("a", "b")
    return named.unionByName(known.select(F.col("id").alias("a"), F.explode("codes").alias("b")))


def grouped(known: DataFrame) -> DataFrame:
    """id, component: every sample that is linked to another or shows a coded object."""
    return components(relations(known)).where("node >= 0").withColumnRenamed("node", "id")


def torn(samples: DataFrame) -> DataFrame:
    """group_id, sample_id: all members of each group whose members have two or more different recorded splits.

    group_id is the smallest sample id of the group. Samples without a recorded split are members, but tear nothing;
    repeated rows of an id are one sample with all its splits.
    """
    known = cut(facts(samples))
    members = cut(grouped(known))
    spans = (
        members.join(known.where("split is not null").select("id", "split"), "id", "left").groupBy("component")
        .agg(F.min("id").alias("group_id"), F.min("split").alias("low"), F.max("split").alias("high"), F.count("*").alias("n")).where("low <> high").select("component", "group_id", "n")
    )
    return attach(members, cut(spans), "component", "id", counted="n").selectExpr("group_id", "id as sample_id")


def assign(samples: DataFrame, targets: DataFrame, seed: int = 7) -> DataFrame:
    """sample_id, group_id, split: every sample, with all members of a group in one split.

    Weighted rendezvous hashing: a group goes to the split with the smallest -ln(u) / weight, u a hash of group and
    split. Adding a split or changing a share moves only as many groups as it must. Groups with more than a GIANT-th of
    all samples would make shares a matter of luck: they are placed first, each in the split that lacks most, and the
    weights of the others are what is then left. What the hashes of few or uneven groups still miss is mended by correcting
    the weights until the samples they give each split are what was left. Targets that are null or not above zero get nothing.
    """
    wanted = [(r["split_name"], float(r["target_share"])) for r in targets.where("split_name is not null and target_share > 0").limit(MAX_SPLITS + 1).collect()]
    if len(wanted) > MAX_SPLITS:
        raise ValueError(f"more than {MAX_SPLITS} splits")
    if not wanted:
        raise ValueError("no split has a positive share")
    known = cut(facts(samples))
    every = cut(known.select("id").distinct().join(grouped(known), "id", "left").select(F.col("id").alias("sample_id"), F.coalesce("component", "id").alias("group_id")))
    sizes = cut(every.groupBy("group_id").agg(F.count("*").alias("n")))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    # Fewer than GIANT groups can be that large.
    giant = F.col("n") > max(total // GIANT, 1)
    giants = sizes.where(giant).orderBy(F.desc("n"), "group_id").collect()
    all_shares = sum(s for _, s in wanted)
    left = {name: share / all_shares * total for name, share in sorted(wanted)}
    placed = {}
    for r in giants:
        name = max(left, key=lambda k: (left[k], k))
        placed[r["group_id"]] = name
        left[name] -= r["n"]
    goal = {name: room for name, room in left.items() if room > 0} or dict(wanted)

    def by_hash(weights: dict[str, float]) -> Column:
        bids = []
        for name, weight in weights.items():
            u = (F.pmod(F.xxhash64(F.col("group_id"), F.lit(name), F.lit(seed)), F.lit((1 << 52) - 1)) + 1) / F.lit(float(1 << 52))
            bids.append(F.struct((-F.log(u) / F.lit(weight)).alias("bid"), F.lit(name).alias("split")))
        return F.array_min(F.array(*bids))["split"]

    best = by_hash(_corrected(sizes.where(~giant), goal, by_hash, total))
    if placed:
        best = F.coalesce(F.create_map(*[x for k, v in placed.items() for x in (F.lit(k).cast("long"), F.lit(v))])[F.col("group_id")], best)
    return every.select("sample_id", "group_id", best.alias("split"))


def _corrected(sizes: DataFrame, goal: dict[str, float], by_hash: Callable[[dict[str, float]], Column], total: int) -> dict[str, float]:
    """Weights whose splits hold the samples of goal as nearly as was found; sizes: group_id, n."""
    weights, best = dict(goal), (float("inf"), dict(goal))
    for _ in range(CORRECTIONS):
        got = {r["split"]: r["n"] for r in sizes.groupBy(by_hash(weights).alias("split")).agg(F.sum("n").alias("n")).collect()}
        all_got = sum(got.values())
        if not all_got or len(goal) == 1:
            return goal
        want = {k: v / sum(goal.values()) * all_got for k, v in goal.items()}
        off = max(abs(got.get(k, 0) - v) for k, v in want.items()) / total
        best = min(best, (off, weights), key=lambda x: x[0])
        if off <= CLOSE:
            break
        weights = {k: weights[k] * min(2.0, max(0.5, want[k] / max(got.get(k, 0), 1e-9))) for k in weights}
    return best[1]


def balance(assigned: DataFrame, targets: DataFrame) -> DataFrame:
    """split_name, target_share, samples, share: what came out."""
    got = assigned.groupBy(F.col("split").alias("split_name")).agg(F.count("*").alias("samples"))
    total = F.sum("samples").over(Window.partitionBy())  # one row a split
    x = targets.select("split_name", "target_share").join(F.broadcast(got), "split_name", "left").withColumn("samples", F.coalesce("samples", F.lit(0)))
    return x.select("split_name", "target_share", "samples", (F.col("samples") / F.nullif(total, F.lit(0))).alias("share"))


def checked(assigned: DataFrame, targets: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """samples, groups, torn_groups, balanced: one row about a whole assignment.

    balanced: every share is within the tolerance of its target, but for what the largest group makes unavoidable.
    """
    per = assigned.groupBy("group_id").agg(F.count("*").alias("n"), F.min("split").alias("low"), F.max("split").alias("high"))
    sums = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("samples"), F.count("*").alias("groups"), F.count_if(F.col("low") != F.col("high")).alias("torn_groups"), (F.coalesce(F.max("n"), F.lit(0)) / F.sum("n")).alias("largest"))
    off = balance(assigned, targets).agg(F.max(F.abs(F.col("share") - F.col("target_share")))).first()[0]
    return sums.select("samples", "groups", "torn_groups", (F.lit(off or 0.0) <= F.greatest(F.lit(tolerance), F.coalesce("largest", F.lit(0.0)))).alias("balanced"))
