"""Parent-child links to full hierarchies, by heavy-path decomposition.

Trees of unknown depth are cut into heavy chains: every inner node continues the chain of its parent if it has the
largest subtree among its siblings. A path from the root crosses at most log2(n) chains, so once chains are labelled,
paths are concatenations of chain segments and descendants are intervals of the preorder in which chains are contiguous.

All rounds are joins on single keys with doubling distances: a lineage of depth d takes about log2(d) rounds. No step
collects a tree, a chain or a sibling group into one task: hot parents are reduced by partial aggregation before the
shuffle, and where many rows look one key up, they are spread over parts. Frames have as many partitions as their rows
fill, so the rounds of a small forest need no shuffles; what a round has to know is counted while it is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimento.operators.ranking import HOT_ROWS, copied, hot_keys, salted
from sedimento.session import cut_counted, release

KEY = ["g", "node"]
SIBLING_BUCKETS = 1 << 16
PRE_RUN = 64
ROWS_A_TASK = 500_000


def _written(df: DataFrame, **counts) -> tuple[DataFrame, dict]:
    """df written, in partitions of about ROWS_A_TASK rows, with its number of rows and other counts."""
    table, seen = cut_counted(df, rows=F.count("*"), **counts)
    out = table.coalesce(max(1, -(-seen["rows"] // ROWS_A_TASK)))
    out.written_to = table.written_to
    return out, seen


def _looked_up(rows: DataFrame, values: DataFrame, on: list[str], row_id: str, n: int, how: str = "left") -> DataFrame:
    """rows (n of them) joined with values (one row a key); hot keys, and rows whose key is null, are spread over parts."""
    if n <= HOT_ROWS:
        return rows.join(values, on, how)
    hot = hot_keys(rows.where(F.col(on[-1]).isNotNull()), on, HOT_ROWS)
    x = salted(rows, hot, on, row_id)
    x = x.withColumn("salt__", F.when(F.col(on[-1]).isNull(), F.pmod(F.xxhash64(row_id), F.lit(1 << 16)).cast("int")).otherwise(F.col("salt__")))
    return x.join(copied(values, hot, on), [*on, "salt__"], how).drop("salt__")


def _subtree_sizes(edges: DataFrame, n: int) -> tuple[DataFrame, DataFrame | None]:
    """(g, node, parent, size) of every node whose lineage ends, and (g, node, anc, low) of those that never reach a root.

    After round k, `anc` is the 2^k-th ancestor, `size` counts descendants less than 2^k levels below and `low` is the
    smallest id of the node and its 2^k - 1 next ancestors. A node at distance exactly 2^k hands its own count up. When a
    round ends no further lineage, what still runs is cyclic.
    """
    none = F.lit(None).cast(edges.schema["anc"].dataType)
    tops = edges.select("g", F.col("anc").alias("node")).distinct().join(edges.select("g", "node"), KEY, "left_anti").withColumn("anc", none)
    state = edges.select("g", "node", "anc").unionByName(tops.select("g", "node", "anc")).select("g", "node", F.col("anc").alias("parent"), "anc", F.lit(1).cast("long").alias("size"), F.col("node").alias("low"))
    running = n
    while running:
        given = state.where("anc is not null").groupBy("g", F.col("anc").alias("node")).agg(F.sum("size").alias("given"))
        hop = state.where("anc is not null").select("g", F.col("node").alias("anc"), F.col("anc").alias("anc2"), F.col("low").alias("low2"))
        x = _looked_up(state.join(given, KEY, "left"), hop, ["g", "anc"], "node", n)
        x = x.select("g", "node", "parent", F.col("anc2").alias("anc"), (F.col("size") + F.coalesce("given", F.lit(0))).alias("size"), F.least("low", "low2").alias("low"))
        before, old = running, state
        state, told = _written(x, running=F.count("anc"))
        running = told["running"]
        release(old)
        if running == before:
            return state.where("anc is null").drop("anc", "low"), state.where("anc is not null").drop("size", "parent")
    return state.drop("anc", "low"), None


def _cycle_roots(endless: DataFrame, n: int) -> DataFrame:
    """(g, node, root): the smallest id on the cycle that each endless lineage runs into.

    Doubling goes on until the set of ancestors, which shrinks to the cycles, and the smallest ids stay as they are: then
    every ancestor is on its cycle, and its smallest id is that of the cycle.
    """
    on_way, moved = -1, True
    while (now := endless.select("g", "anc").distinct().count()) != on_way or moved:
        on_way = now
        hop = endless.select("g", F.col("node").alias("anc"), F.col("anc").alias("anc2"), F.col("low").alias("low2"))
        x = _looked_up(endless, hop, ["g", "anc"], "node", n, "inner")
        x = x.select("g", "node", F.col("anc2").alias("anc"), F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("moved"))
        old = endless
        endless, told = _written(x, moved=F.count_if("moved"))
        release(old)
        moved = told["moved"] > 0
    return _looked_up(endless, endless.select("g", F.col("node").alias("anc"), F.col("low").alias("root")), ["g", "anc"], "node", n, "inner").select("g", "node", "root")


def _doubled(run: DataFrame, step, n: int) -> DataFrame:
    """run (any frame with what step needs) after rounds of step until none moves a row any more.

    step(run) doubles all distances and says in `moved` which rows got further. Small frames are doubled twice a round.
    """
    moved = True
    while moved:
        x = step(step(run).drop("moved")) if n <= HOT_ROWS else step(run)
        old = run
        run, told = _written(x, moved=F.count_if("moved"))
        release(old)
        moved = told["moved"] > 0
    return run.drop("moved")


def _chains(known: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(g, node, size, anc, head, pos) of every node, and (g, anc, heavy, heavy_size) of every parent."""
    heavy, _ = _written(
        known.where("parent is not null").groupBy("g", F.col("parent").alias("anc"))
        .agg(F.max(F.struct("size", (-F.col("node")).alias("minus"))).alias("top"))
        .select("g", "anc", (-F.col("top.minus")).alias("heavy"), F.col("top.size").alias("heavy_size"))
    )

    def step(run: DataFrame) -> DataFrame:
        up = run.select("g", F.col("node").alias("head"), F.col("head").alias("head2"), F.col("pos").alias("pos2"))
        x = _looked_up(run, up, ["g", "head"], "node", n)
        return x.select("g", "node", F.coalesce("head2", "head").alias("head"), (F.col("pos") + F.coalesce("pos2", F.lit(0))).alias("pos"), F.col("head2").isNotNull().alias("moved"))

    run = _doubled(heavy.select("g", F.col("heavy").alias("node"), F.col("anc").alias("head"), F.lit(1).cast("long").alias("pos")), step, n)
    nodes = known.join(run, KEY, "left").select("g", "node", "size", F.col("parent").alias("anc"), F.coalesce("head", "node").alias("head"), F.coalesce("pos", F.lit(0)).alias("pos"))
    return _written(nodes)[0], heavy


def _offsets(light: DataFrame, heavy: DataFrame) -> DataFrame:
    """(g, node, offset): preorder distance from a light child to its parent: the heavy subtree first, then siblings.

    Prefix sums run over sibling buckets and then inside a bucket, so a parent holding a third of all rows is spread out.
    """
    light = light.withColumn("bucket", F.pmod(F.xxhash64("node"), F.lit(SIBLING_BUCKETS)))
    at = ["g", "anc", "bucket"]
    sums = light.groupBy(*at).agg(F.sum("size").alias("in_bucket"))
    before = F.sum("in_bucket").over(Window.partitionBy("g", "anc").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    inside = F.sum("size").over(Window.partitionBy(*at).orderBy("node").rowsBetween(Window.unboundedPreceding, -1))
    buckets = sums.join(heavy.select("g", "anc", "heavy_size"), ["g", "anc"]).withColumn("start", 1 + F.col("heavy_size") + F.coalesce(before, F.lit(0))).select(*at, "start")
    return light.withColumn("inside", F.coalesce(inside, F.lit(0))).join(buckets, at).select("g", "node", (F.col("start") + F.col("inside")).alias("offset"))


def hierarchy(nodes: DataFrame, intervals: bool = True) -> DataFrame:
    """Place every node of a forest.

    nodes: g (which forest), node, parent; the key columns may be of any ordered numeric type; other columns are ignored.
    Returns g, node, parent, root, depth, chain_head, chain_pos, segments, and with `intervals` also pre and size.

    * root/depth: topmost ancestor and number of links to it; a parent that is not a node counts as none (depth 0).
    * depth -1: the lineage never ends; root is then the smallest id on the cycle reached, the chain columns are null.
    * segments: array of (head, pos), root first: the path is nodes 0..pos of each chain in turn, ending at the node.
    * pre/size: the descendants of v are the nodes of the same g and root with pre in (v.pre, v.pre + v.size - 1].
    Null nodes are dropped, repeated nodes count once (smallest non-null parent), an empty input gives an empty result.
    """
    plain = nodes.select("g", "node", "parent").where("node is not null")
    listed = plain.groupBy("g", "node").agg(F.min("parent").alias("parent"))
    asked = listed.where("parent is not null").select("g", "node", F.col("parent").alias("anc"))
    asked, told = _written(asked)
    ids = plain.select("g", F.col("node").alias("anc")).distinct()
    edges, told = _written(_looked_up(asked, ids, ["g", "anc"], "node", told["rows"], "left_semi").select("g", "node", "anc"))
    n = told["rows"]
    known, endless = _subtree_sizes(edges, n)
    placed, heavy = _chains(known, n)

    heads = placed.where("pos = 0 and anc is not null").select("g", F.col("node").alias("head"), "anc", "size")
    at = placed.select("g", F.col("node").alias("anc"), F.col("head").alias("up"), F.col("pos").alias("up_pos"))
    tree = _looked_up(heads, at, ["g", "anc"], "head", n, "inner").withColumn("off", F.col("up_pos") + 1)
    if intervals:
        offs = _offsets(heads.select("g", F.col("head").alias("node"), "anc", "size"), heavy).withColumnRenamed("node", "head")
        tree = tree.join(offs, ["g", "head"]).withColumn("pre", F.col("up_pos") + F.col("offset"))
    else:
        tree = tree.withColumn("pre", F.lit(None).cast("long"))
    tree, _ = _written(tree.select("g", "head", "up", "off", "pre", F.array(F.struct(F.col("up").alias("head"), F.col("up_pos").alias("pos"))).alias("segments")))

    def step(tree: DataFrame) -> DataFrame:
        above = tree.select("g", F.col("head").alias("up"), F.col("up").alias("up2"), F.col("off").alias("off2"), F.col("pre").alias("pre2"), F.col("segments").alias("segments2"))
        return _looked_up(tree, above, ["g", "up"], "head", n).select(
            "g", "head", F.coalesce("up2", "up").alias("up"), (F.col("off") + F.coalesce("off2", F.lit(0))).alias("off"), (F.col("pre") + F.coalesce("pre2", F.lit(0))).alias("pre"),
            F.when(F.col("up2").isNull(), F.col("segments")).otherwise(F.concat("segments2", "segments")).alias("segments"), F.col("up2").isNotNull().alias("moved"),
        )

    tree = _doubled(tree, step, n)
    here = F.array(F.struct(F.col("head"), F.col("pos")))
    done = _looked_up(placed.drop("anc"), tree, ["g", "head"], "node", n).select(
        "g", "node", F.coalesce("up", "head").alias("root"), (F.coalesce("off", F.lit(0)) + F.col("pos")).alias("depth"), F.col("head").alias("chain_head"), F.col("pos").alias("chain_pos"),
        F.when(F.col("up").isNull(), here).otherwise(F.concat("segments", here)).alias("segments"), (F.coalesce("pre", F.lit(0)) + F.col("pos")).alias("pre"), "size",
    )
    if endless is not None:
        null = {c: F.lit(None).cast(done.schema[c].dataType).alias(c) for c in done.columns}
        rest = _cycle_roots(endless, n).withColumn("depth", F.lit(-1).cast("long"))
        done = done.unionByName(rest.select(*[rest[c] if c in rest.columns else null[c] for c in done.columns]))
    alone = F.col("root").isNull()
    out = listed.join(done, KEY, "left").select(
        *KEY, "parent", F.coalesce("root", "node").alias("root"), F.coalesce("depth", F.lit(0)).alias("depth"),
        F.when(alone, F.col("node")).otherwise(F.col("chain_head")).alias("chain_head"), F.when(alone, F.lit(0).cast("long")).otherwise(F.col("chain_pos")).alias("chain_pos"),
        F.when(alone, F.array(F.struct(F.col("node").alias("head"), F.lit(0).cast("long").alias("pos")))).otherwise(F.col("segments")).alias("segments"),
        F.when(alone, F.lit(0).cast("long")).otherwise(F.col("pre")).alias("pre"), F.when(alone, F.lit(1).cast("long")).otherwise(F.col("size")).alias("size"),
    )
    return out if intervals else out.drop("pre", "size")


def paths(placed: DataFrame) -> DataFrame:
    """g, node, step, ancestor: the whole path of every node, root first (step 0), from the chain segments.

    One row a step instead of one string a node: a lineage of any depth stays spread over tasks. Endless lineages have
    no path and give no rows.
    """
    members = placed.where("depth >= 0").select("g", F.col("chain_head").alias("head"), F.col("chain_pos").alias("at"), F.col("node").alias("ancestor"), F.col("depth").alias("step"))
    parts = placed.where("depth >= 0").select("g", "node", F.explode("segments").alias("s")).select("g", "node", "s.head", "s.pos")
    return parts.join(members, ["g", "head"]).where("at <= pos").select("g", "node", "step", "ancestor")


def descendants(placed: DataFrame) -> DataFrame:
    """g, node, descendant, distance: every proper descendant, the inverse reading of the chain segments."""
    depth = placed.select("g", F.col("node").alias("descendant"), F.col("depth").alias("d"))
    return (
        paths(placed).where("node <> ancestor").select("g", F.col("ancestor").alias("node"), F.col("node").alias("descendant"), "step")
        .join(depth, ["g", "descendant"]).select("g", "node", "descendant", (F.col("d") - F.col("step")).alias("distance"))
    )


def descendants_by_interval(placed: DataFrame) -> DataFrame:
    """g, node, descendant: every proper descendant, from the preorder intervals (placed with intervals).

    Intervals are looked up in runs of PRE_RUN places of their tree: at most one row for each run an interval touches, so
    the work follows the result, not the square of a tree.
    """
    at = placed.where("depth >= 0").select("g", "root", "node", "pre", "size")
    run = lambda c: F.floor(c / F.lit(PRE_RUN))
    first, last = F.col("pre") + 1, F.col("pre") + F.col("size") - 1
    above = at.where("size > 1").select("g", "root", "node", first.alias("first"), last.alias("last"), F.explode(F.sequence(run(first), run(last))).alias("run"))
    below = at.select("g", "root", F.col("node").alias("descendant"), "pre", run(F.col("pre")).alias("run"))
    return above.join(below, ["g", "root", "run"]).where("pre between first and last").select("g", "node", "descendant")


def catalog_links(datasets: DataFrame, samples: DataFrame) -> DataFrame:
    """The two lineage tables of the catalog as one forest input."""
    return datasets.select(F.lit("datasets").alias("g"), F.col("id").alias("node"), F.col("parent_dataset_id").alias("parent")).unionByName(
        samples.select(F.lit("samples").alias("g"), F.col("id").alias("node"), F.col("source_sample_id").alias("parent"))
    )
