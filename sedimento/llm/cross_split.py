"""Same or near-same records across splits: evaluation samples that occur again among the train samples.

Exact copies meet by hash. Near copies: a fingerprint of 144 bits is the set of its 144 (position, bit) shingles, and
Jaccard similarity (144 - d) / (144 + d) orders pairs exactly as d differing bits do: at most 10 bits is a Jaccard of at
least 134/154 = 0.870. Minwise signatures are cut into bands, and only pairs of the two sides that meet in a bucket are
verified (operators/hamming.py; its bands are probed so that no pair is lost).

Samples of equal content (hash and fingerprints) are one class in all of the search, however many they are. Pairs of
classes are what is found; pairs of samples are only made where they are asked for, and counts come without them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimento.functions import reading
from sedimento.operators import hamming
from sedimento.operators.ranking import copied, hot_keys, salted
from sedimento.session import cut

MAX_BITS = 10
MIN_JACCARD = (hamming.BITS - MAX_BITS) / (hamming.BITS + MAX_BITS)
_WORDS = hamming.words(hamming.BITS)


def split_records(samples: DataFrame) -> DataFrame:
    """id, train, split, origin, hash, prints, content of every sample that has a recorded split and anything to compare.

    content is a digest of the hash and the set of fingerprints: what it is equal for is one class.
    """
    s = samples.where("id is not null").select("id", reading.content_hash(F.col("sha256")).alias("hash"), reading.labels(F.col("labels_json")).alias("l"), reading.fields(F.col("metadata_json")).alias("m"))
    s = s.select("id", "hash", reading.recorded_split(F.col("l"), F.col("m")).alias("split"), F.coalesce(F.array_sort(hamming.fingerprints(F.col("l"))), F.array()).alias("prints"), reading.canonical_word(F.coalesce(F.col("m")["origin"], F.lit(""))).alias("origin"))
    s = s.where("split is not null and (hash is not null or size(prints) > 0)")
    return s.select("id", (F.col("split") == "train").alias("train"), "split", "origin", "hash", "prints", F.unhex(F.md5(F.to_json(F.struct("hash", "prints")))).alias("content"))


def _joined(e: DataFrame, t: DataFrame, key: str) -> DataFrame:
    """Pairs of classes that share a key; a key with very many classes on the train side is spread over parts."""
    hot = hot_keys(t, [key])
    return copied(e, hot, [key]).join(salted(t, hot, [key], "t"), [key, "salt__"])


def class_pairs(records: DataFrame) -> DataFrame:
    """e, t, same_hash, near: classes of evaluation and of train samples that share a hash or have near fingerprints.

    records: as from split_records, cheap to read again. The two sides of a pair may be the same content.
    """
    classes = cut(records.select("train", "content", "hash", "prints").distinct())
    side = lambda train: classes.where("train" if train else "not train")
    same = _joined(side(False).where("hash is not null").select("hash", F.col("content").alias("e")), side(True).where("hash is not null").select("hash", F.col("content").alias("t")), "hash")
    same = same.select("e", "t", F.lit(True).alias("same_hash"), F.lit(False).alias("near"))

    prints = lambda train: side(train).select("content", F.inline("prints"))
    distinct = cut(prints(False).drop("content").distinct().withColumn("train", F.lit(False)).unionByName(prints(True).drop("content").distinct().withColumn("train", F.lit(True))))
    near = hamming.near_pairs(distinct.where("not train"), distinct.where("train"), MAX_BITS)
    shared = hamming.BITS - F.col("bits")
    near = near.where(shared / (hamming.BITS + F.col("bits")) >= F.lit(MIN_JACCARD - 1e-9)).drop("bits")
    named = lambda train, s: prints(train).select("algo", *[F.col(w).alias(f"{s}{k}") for k, w in enumerate(_WORDS)], F.col("content").alias(s))
    near = near.join(named(False, "e"), ["algo", "e0", "e1", "e2"]).join(named(True, "t"), ["algo", "t0", "t1", "t2"]).select("e", "t", F.lit(False).alias("same_hash"), F.lit(True).alias("near"))
    return same.unionByName(near).groupBy("e", "t").agg(F.max("same_hash").alias("same_hash"), F.max("near").alias("near"))


def overlaps(samples: DataFrame) -> DataFrame:
    """evaluation_id, train_id, same_hash, near: all pairs of an evaluation (validation, test) and a train sample.

    Pairs share the hash, or have fingerprints of one algo that differ in at most 10 bits. Samples without a recorded
    split are in no pair; null or malformed hashes and fingerprints match nothing; an empty table gives no pairs. Each
    pair comes once.
    """
    records = cut(split_records(samples))
    pairs = class_pairs(records)
    for side, name, train in (("e", "evaluation_id", False), ("t", "train_id", True)):
        members = records.where("train" if train else "not train").select(F.col("content").alias(side), F.col("id").alias(name))
        hot = hot_keys(members, [side])
        pairs = copied(pairs, hot, [side]).join(salted(members, hot, [side], name), [side, "salt__"]).drop("salt__")
    return pairs.groupBy("evaluation_id", "train_id").agg(F.max("same_hash").alias("same_hash"), F.max("near").alias("near"))


def overlap_report(samples: DataFrame) -> DataFrame:
    """split, origin, pairs, evaluation_samples: overlaps counted by split and source of the evaluation sample.

    Counted from pairs of classes and the sizes of classes; no pair of samples is made. A sample id counts once for each
    split, origin and content it is recorded with.
    """
    records = cut(split_records(samples))
    sizes = lambda train, *by: records.where("train" if train else "not train").groupBy("content", *by).agg(F.count_distinct("id").alias("n"))
    trained = class_pairs(records).join(sizes(True).withColumnRenamed("content", "t"), "t").groupBy(F.col("e").alias("content")).agg(F.sum("n").alias("each"))
    return sizes(False, "split", "origin").join(trained, "content").groupBy("split", "origin").agg(F.sum(F.col("n") * F.col("each")).alias("pairs"), F.sum("n").alias("evaluation_samples"))
