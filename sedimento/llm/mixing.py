"""Mixing sources to target weights, by capped water-filling.

Sizes are tokens. A source can give at most its size times its cap of repeats. Sources whose share asks for more are
clamped at their cap and the missing weight goes to the others in proportion, again until all fit. What a source must
give divided by its size is its number of epochs: the whole part repeats every record, the fraction is a seeded draw.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimento.functions import reading
from sedimento.session import cut

# Fixed pattern: one Chinese character, or one run of ASCII letters, digits and underscores.
TOKEN = r"[一-鿿]|[A-Za-z0-9_]+"
MIX_FRACTION = 0.5
MAX_SOURCES = 10_000


def tokens(text: Column) -> Column:
    """Token count without building the tokens: the characters that begin one are kept and counted."""
    return F.coalesce(F.length(F.regexp_replace(F.regexp_replace(text, r"[A-Za-z0-9_]+", "一"), r"[^一-鿿]+", "")), F.lit(0)).cast("long")


@dataclass(frozen=True)
class Share:
    source: str
    available: int
    target: float
    cap: int
    epochs: float
    wanted: float
    short: bool


def water_fill(sources: list[tuple[str, int, float, int]], size: float) -> list[Share]:
    """(name, tokens, target share, max repeats) and the size of the mix -> epochs of each source.

    In the first round every source asks for its target share. Sources that ask for more than they can give are clamped
    there; those clamped below their own target are short. Later rounds only hand on what clamped sources left open.
    """
    wanted = {s[0]: max(0.0, s[2]) * size for s in sources}
    room = {s[0]: float(s[1] * s[3]) for s in sources}
    given = dict.fromkeys(wanted, 0.0)
    free = {n for n in given if wanted[n] > 0}
    left, asked = min(size, sum(wanted.values())), dict(wanted)
    while free and left > 1e-9:
        full = {n for n in free if asked[n] >= room[n] - given[n]}
        if not full:
            total = sum(asked[n] for n in free)
            for n in free:
                given[n] += asked[n] * left / total
            break
        for n in full:
            take = min(room[n] - given[n], left)
            left -= take
            given[n] += take
        free -= full
        total = sum(wanted[n] for n in free)
        asked = {n: wanted[n] / total * left for n in free}
    return [Share(n, t, w, c, given[n] / t if t else 0.0, wanted[n], room[n] < wanted[n] and n not in free) for n, t, w, c in sources]


def sizes(documents: DataFrame) -> DataFrame:
    """source_name, tokens: null for documents without a source; spellings of a source are one."""
    name = reading.canonical_word(F.col("source"))
    return documents.select(F.when(name != "", name).alias("source_name"), tokens(F.col("text")).alias("t")).groupBy("source_name").agg(F.sum("t").alias("tokens"))


def plan(documents: DataFrame, targets: DataFrame) -> list[Share]:
    """One Share for each target source; the mix has half of the tokens of all documents, which are read once."""
    rows = targets.where("source_name is not null").orderBy("source_name").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    have = cut(sizes(documents))
    named = F.broadcast(targets.select(reading.canonical_word(F.col("source_name")).alias("source_name")).distinct())
    got = {r["source_name"]: r["tokens"] for r in have.join(named, "source_name", "left_semi").collect()}  # one row a target
    total = have.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    return water_fill([(r["source_name"], got.get(_word(r["source_name"]), 0), float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in rows], MIX_FRACTION * total)


def _word(name: str) -> str:
    return "_".join(name.strip().lower().replace("-", " ").replace("_", " ").split())


def report(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """source_name, available, target_share, actual_share, epochs, short: the mix by source.

    `short`: even all allowed repeats give fewer tokens than the target share of the mix. Null repeats count as none,
    null shares as zero; an unknown source has no tokens; empty documents make an empty mix that is short of nothing.
    """
    shares = plan(documents, targets)
    total = sum(s.epochs * s.available for s in shares) or 1.0
    rows = [(s.source, s.available, s.target, s.epochs * s.available / total, s.epochs, s.short) for s in shares]
    return documents.sparkSession.createDataFrame(rows, "source_name string, available long, target_share double, actual_share double, epochs double, short boolean")


def _used(documents: DataFrame, shares: list[Share], seed: int) -> DataFrame:
    """The documents of the mix with source_name and times, the number of uses."""
    epochs = F.create_map(*[x for s in shares if s.epochs > 0 for x in (F.lit(_word(s.source)), F.lit(float(s.epochs)))]) if any(s.epochs > 0 for s in shares) else None
    x = documents.select("doc_id", "text", reading.canonical_word(F.col("source")).alias("source_name"))
    x = x.withColumn("epochs", epochs[F.col("source_name")] if epochs is not None else F.lit(None).cast("double")).where("epochs > 0")
    u = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    return x.withColumn("times", (F.floor("epochs") + F.when(u < F.col("epochs") - F.floor("epochs"), 1).otherwise(0)).cast("int")).where("times > 0")


def mix(documents: DataFrame, targets: DataFrame, seed: int = 7) -> DataFrame:
    """doc_id, source_name, repeat: the mixed corpus; repeat counts the uses of a document from 0.

    Every document of a source is used floor(epochs) times and once more if its seeded hash falls below the fraction.
    Documents of other sources or none are not in the mix; null texts have no tokens but are repeated like others.
    """
    used = _used(documents, plan(documents, targets), seed)
    return used.select("doc_id", "source_name", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("repeat"))


def mix_shares(documents: DataFrame, targets: DataFrame, seed: int = 7) -> DataFrame:
    """source_name, target_share, planned_share, uses, tokens, actual_share, largest_repeat, short: what the drawn mix really holds.

    Counted from the drawn documents, with their own sizes; a source that nothing was drawn from has zeros.
    """
    shares = plan(documents, targets)
    total = sum(s.epochs * s.available for s in shares) or 1.0
    want = documents.sparkSession.createDataFrame([(s.source, _word(s.source), s.target, s.epochs * s.available / total, s.short) for s in shares], "source_name string, word string, target_share double, planned_share double, short boolean")
    got = _used(documents, shares, seed).groupBy(F.col("source_name").alias("word")).agg(F.sum("times").alias("uses"), F.sum(F.col("times") * tokens(F.col("text"))).alias("tokens"), F.max("times").alias("largest_repeat"))
    x = want.join(F.broadcast(got), "word", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    return x.select("source_name", "target_share", "planned_share", n("uses").alias("uses"), n("tokens").alias("tokens"), (n("tokens") / F.nullif(F.sum("tokens").over(Window.partitionBy()), F.lit(0))).alias("actual_share"), n("largest_repeat").alias("largest_repeat"), "short")


def checked(documents: DataFrame, targets: DataFrame, seed: int = 7, tolerance: float = 0.02) -> DataFrame:
    """source_name, short, capped, close: of each target source, whether the drawn mix keeps its cap of repeats and its planned share."""
    caps = targets.groupBy("source_name").agg(F.max(F.coalesce("max_repeats", F.lit(0))).alias("cap"))
    x = mix_shares(documents, targets, seed).join(F.broadcast(caps), "source_name")
    return x.select("source_name", "short", (F.col("largest_repeat") <= F.col("cap")).alias("capped"), (F.abs(F.coalesce("actual_share", F.lit(0.0)) - F.col("planned_share")) <= tolerance).alias("close"))
