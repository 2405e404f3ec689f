"""Cleaning: suggestions, their review, what is stored in the end.

Every operator gives suggestions (sample_id, issue_type, suggested_action, confidence, message, related_id); a sample
without a finding gives none. Several operators are one plan: their suggestions are a union.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimento.functions import reading
from sedimento.operators import hamming, pixels, textops
from sedimento.operators.catalog import active_samples, operation
from sedimento.operators.ranking import attach, copied, hot_keys, salted
from sedimento.session import cut, release

SUGGESTION = ("sample_id", "issue_type", "suggested_action", "confidence", "message", "related_id")
# Which status a suggestion may go to.
TRANSITIONS = {"pending": ("approved", "rejected", "applied"), "approved": ("rejected", "applied"), "rejected": (), "applied": ()}


def _shape(df: DataFrame, issue: str, action: str, related: str | None = None) -> DataFrame:
    x = df.withColumns({"issue_type": F.lit(issue), "suggested_action": F.lit(action), "related_id": F.col(related).cast("long") if related else F.lit(None).cast("long")})
    return x.select(F.col("sample_id").cast("long").alias("sample_id"), "issue_type", "suggested_action", F.col("confidence").cast("double").alias("confidence"), "message", "related_id")


def exact_duplicates(samples: DataFrame) -> DataFrame:
    """Later samples of the same content; related_id is the first (smallest id). Samples without a hash are never copies."""
    rows = samples.select(F.col("id").alias("sample_id"), reading.content_hash(F.col("sha256")).alias("hash")).where("hash is not null and sample_id is not null")
    groups = rows.groupBy("hash").agg(F.min("sample_id").alias("first"), F.max("sample_id").alias("last")).where("first < last").drop("last")
    later = attach(rows, groups, "hash", "sample_id").where("sample_id > first").select("sample_id", "first").distinct()
    return _shape(later.withColumns({"confidence": F.lit(1.0), "message": F.concat(F.lit("Same content as sample "), F.col("first").cast("string"))}), "duplicate", "delete", "first")


def leaders(prints: DataFrame, max_bits: int, width: int = hamming.BITS, nearest: bool = True) -> DataFrame:
    """Greedy leader clustering: id, leader_id, bits of every fingerprint that is near an earlier leader.

    prints: id, algo, f0, f1, ... (as many as `width` bits take). In order of id, a fingerprint joins the nearest earlier leader within max_bits (the
    first of equally near ones; with nearest=False the first of all), else it leads itself. The order-dependent loop is computed in rounds: a node whose
    earlier neighbours include a leader is no leader; a node whose earlier neighbours are all decided otherwise is one.
    """
    value = ["algo", *hamming.words(width)]
    nodes = cut(prints.groupBy(*value).agg(F.min("id").alias("node"), F.count("*").alias("n")))
    pairs = hamming.near_pairs(nodes, nodes, max_bits, ["node"], width, later_than="node").select(F.col("e_node").alias("late"), F.col("t_node").alias("early"), "bits")
    pairs = cut(pairs)
    near_many = hot_keys(pairs, ["early"])  # fingerprints that very many are near to
    spread = salted(pairs, near_many, ["early"], "late")
    of_early = lambda states: copied(states.withColumnRenamed("node", "early"), near_many, ["early"])
    late = pairs.select(F.col("late").alias("node")).distinct()
    first = pairs.select(F.col("early").alias("node")).distinct().join(late, "node", "left_anti")
    state = cut(late.withColumn("s", F.lit(0)).unionByName(first.withColumn("s", F.lit(1))))  # 0 open, 1 leads, 2 follows
    while state.where("s = 0").limit(1).count():
        seen = spread.join(of_early(state), ["early", "salt__"]).groupBy(F.col("late").alias("node")).agg(F.max((F.col("s") == 1).cast("int")).alias("led"), F.min((F.col("s") == 2).cast("int")).alias("free"))
        now = F.when(F.col("s") != 0, F.col("s")).when(F.col("led") == 1, 2).when(F.col("free") == 1, 1).otherwise(0)
        old, state = state, cut(state.join(seen, "node", "left").select("node", now.alias("s")))
        release(old)
    led = spread.join(of_early(state.where("s = 1").select("node")), ["early", "salt__"]).drop("salt__").join(state.where("s = 2").select(F.col("node").alias("late")), "late")
    best = F.struct("bits", "early") if nearest else F.struct("early", "bits")
    near = led.groupBy(F.col("late").alias("node")).agg(F.min(best).alias("x")).select("node", "x.bits", F.col("x.early").alias("leader"))
    follow = nodes.drop("n").join(near, "node", "left").withColumn("leader", F.coalesce("leader", "node")).withColumn("bits", F.coalesce("bits", F.lit(0)))
    copies = hot_keys(nodes, value, counted="n")
    return salted(prints, copies, value, "id").join(copied(follow, copies, value), [*value, "salt__"]).where("id <> leader").select("id", F.col("leader").alias("leader_id"), F.col("bits").cast("int").alias("bits"))


def near_duplicates(samples: DataFrame, max_bits: int = 10, min_confidence: float = 0.75, hash_size: int = 8) -> DataFrame:
    """Samples whose fingerprint is near that of an earlier leader; confidence 1 - bits / width, at least min_confidence.

    Fingerprints are those in the labels, of every width, each compared within its own; samples with a column `content`
    are images, compared by their difference hashes of hash_size x hash_size bits.
    """
    if "content" in samples.columns:
        width = hash_size * hash_size
        x = cut(pixels.image_hashes(samples, hash_size))
        groups = [(width, x.select("id", F.lit("dhash").alias("algo"), *hamming.packed(F.col("dhash"), width)))]
    else:
        x = cut(samples.select("id", F.explode(hamming.digit_values(reading.labels(F.col("labels_json")))).alias("p")).select("id", "p.*"))
        sizes = sorted(r[0] for r in x.select(F.length("digits")).distinct().collect()) or [hamming.BITS // 4]  # at most len(DIGITS)
        groups = [(4 * n, x.where(F.length("digits") == n).select("id", "algo", *hamming.packed(F.col("digits"), 4 * n))) for n in sizes]
    every = [leaders(prints, max_bits, width).withColumn("width", F.lit(width)) for width, prints in groups]
    found = reduce(DataFrame.unionByName, every).groupBy(F.col("id").alias("sample_id")).agg(F.min(F.struct("bits", "leader_id", "width")).alias("x")).select("sample_id", "x.*")
    conf = F.greatest(F.lit(min_confidence), F.least(F.lit(1.0), F.bround(1 - F.col("bits") / F.col("width").cast("double"), 4)))
    return _shape(found.withColumns({"confidence": conf, "message": F.concat(F.lit("Near sample "), F.col("leader_id").cast("string"))}), "near_duplicate_image", "delete", "leader_id")


def average_hash_duplicates(files: DataFrame, threshold: int = 0) -> DataFrame:
    """id, leader_id, bits of images (id, content) whose 64-bit average hash is within threshold (0..16) of a leader's: the first such one."""
    x = cut(pixels.image_hashes(files))
    return leaders(x.select("id", F.lit("ahash").alias("algo"), *hamming.packed(F.col("ahash"), 64)), max(0, min(16, threshold)), 64, nearest=False)


def text_suggestions(texts: DataFrame) -> DataFrame:
    """Repeated lines, stop words and unstemmed tokens of texts (id, text), each as a suggestion to repair."""
    out = None
    for issue, op in (("text_duplicate", textops.dedup_lines), ("text_stopwords", textops.remove_stop_words), ("text_unstemmed", textops.stem_tokens)):
        x = op(texts).select(F.col("id").alias("sample_id"), "confidence", F.concat_ws(" of ", F.col("changed").cast("string"), F.col("total").cast("string")).alias("message"))
        one = _shape(x, issue, "repair")
        out = one if out is None else out.unionByName(one)
    return out


def suggest(samples: DataFrame, operators: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """The suggestions of several operators over the active samples."""
    out = None
    for op in operators:
        one = op(active_samples(samples)).select(*SUGGESTION)
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no operators")
    return out


def review(suggestions: DataFrame, decisions: DataFrame) -> DataFrame:
    """suggestions with status as decided (id, decision) where the transition is allowed, and `accepted` saying so."""
    d = decisions.groupBy("id").agg(F.max("decision").alias("decision"))
    allowed = F.lit(False)
    for now, nexts in TRANSITIONS.items():
        allowed = allowed | ((F.col("status") == now) & F.col("decision").isin(*nexts)) if nexts else allowed
    x = suggestions.join(d, "id", "left").withColumn("accepted", F.when(F.col("decision").isNotNull(), F.coalesce(allowed, F.lit(False))))
    return x.withColumn("status", F.when(F.col("accepted"), F.col("decision")).otherwise(F.col("status"))).drop("decision")


def best_suggestion(suggestions: DataFrame) -> DataFrame:
    """One row a sample: its most confident suggestion, the smallest id of equals. Combined before the shuffle."""
    x = suggestions.where("sample_id is not null").select("sample_id", F.struct((-F.coalesce("confidence", F.lit(0.0))).alias("minus"), "id", "issue_type", "suggested_action", "status").alias("x"))
    return x.groupBy("sample_id").agg(F.min("x").alias("x")).select("sample_id", F.col("x.id").alias("suggestion_id"), (-F.col("x.minus")).alias("confidence"), "x.issue_type", "x.suggested_action", "x.status")


def monitor(samples: DataFrame, suggestions: DataFrame, completed: bool = True) -> DataFrame:
    """Every sample with its best suggestion; those without one are kept (confidence 1), or pending while a task runs."""
    x = samples.select(F.col("id").alias("sample_id"), F.col("name").alias("sample_name")).join(best_suggestion(suggestions), "sample_id", "left")
    none = F.col("suggestion_id").isNull()
    word = "keep" if completed else "pending"
    return x.select(
        "sample_id", "sample_name", F.coalesce("suggestion_id", F.lit(-1)).alias("suggestion_id"), F.when(none, "none" if completed else "pending").otherwise(F.col("issue_type")).alias("issue_type"),
        F.when(none, word).otherwise(operation(F.col("suggested_action"))).alias("operation"), F.when(none, 1.0 if completed else 0.0).otherwise(F.col("confidence")).alias("confidence"),
    )


def store_cleaned(samples: DataFrame, suggestions: DataFrame) -> DataFrame:
    """sample_id, stored_from, name: the cleaned dataset.

    Active samples without a delete among their suggestions that were not rejected; the content comes from the output of
    the most confident repair that exists, else from the sample itself.
    """
    valid = suggestions.where("status is null or status <> 'rejected'").where("sample_id is not null").withColumn("op", operation(F.col("suggested_action")))
    per = valid.groupBy("sample_id").agg(
        F.max((F.col("op") == "delete").cast("int")).alias("drop"),
        F.min(F.when((F.col("op") == "repair") & F.col("output_sample_id").isNotNull(), F.struct((-F.coalesce("confidence", F.lit(0.0))).alias("m"), "id", "output_sample_id")))["output_sample_id"].alias("made"),
    )
    x = active_samples(samples).select(F.col("id").alias("sample_id"), "name").join(per, "sample_id", "left").where("coalesce(drop, 0) = 0")
    there = samples.select(F.col("id").alias("made"), F.lit(True).alias("there"))
    return x.join(there, "made", "left").select("sample_id", F.when(F.col("there"), F.col("made")).otherwise(F.col("sample_id")).alias("stored_from"), "name")


def apply_suggestions(samples: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Samples with tombstones: status `deleted` where a delete was applied, `cleaned` where a repair was; deletes win."""
    done = suggestions.where("status = 'applied' and sample_id is not null").withColumn("op", operation(F.col("suggested_action")))
    per = done.groupBy("sample_id").agg(F.max((F.col("op") == "delete").cast("int")).alias("d"), F.max((F.col("op") == "repair").cast("int")).alias("r"))
    status = F.when(F.col("d") == 1, "deleted").when((F.col("r") == 1) & (F.col("status") != "deleted"), "cleaned").otherwise(F.col("status"))
    return samples.join(per.withColumnRenamed("sample_id", "id"), "id", "left").withColumn("status", status).drop("d", "r")
