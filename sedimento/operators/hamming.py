"""Pairs of fingerprints within a Hamming distance, exactly, by banded one-permutation minwise signatures.

A fingerprint of any width is the set of its (position, bit) shingles; two that differ in d of w bits have the Jaccard
similarity (w - d) / (w + d). One fixed permutation of the positions, cut into w bins of the two shingles of a position,
gives a minwise signature of w values, and the values of a band are its bucket. It is kept as longs of 48 bits (f0, f1, ...,
the last holding the lowest bits) beside the name of its algorithm.

All pairs are asked for, so bands also have to meet where a few values differ. max_bits differing bits are dealt out: band i
may differ in t_i, and the sum of t_i + 1 is max_bits + 1, so some band of a near pair keeps to its t_i. A band with t_i > 0
is cut into blocks, and each choice of all blocks but t_i is a bucket: a near pair agrees in one of these whole. Both sides
store the same few buckets. Few narrow ones make few rows, many wide ones few false candidates: how many there are is chosen
by the number of rows on both sides. Every candidate is verified, and kept only in the first bucket that finds it, so no
pair is lost and none comes twice. Buckets with very many rows are spread over parts.
"""

from __future__ import annotations

import random
from itertools import combinations, product
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimento.functions import reading
from sedimento.operators.ranking import copied, hot_keys, salted

BITS, WORD = 144, 48
MOST_BUCKETS = 64  # of a fingerprint
BUCKET_ROWS = 20_000
LEAST_BAND = 8
VERIFY = 0.05  # the cost of a candidate, in shuffled rows
# Hexadecimal digits of hashes of 4 x 4 to 16 x 16 bits.
DIGITS = tuple(-(-n * n // 4) for n in range(4, 17))


def words(width: int) -> list[str]:
    """The columns of a fingerprint of so many bits."""
    return [f"f{k}" for k in range(-(-width // WORD))]


def packed(digits: Column, width: int) -> list[Column]:
    """The longs of a fingerprint in hexadecimal digits."""
    names = words(width)
    whole = F.lpad(digits, 12 * len(names), "0")
    return [F.conv(F.substring(whole, 1 + 12 * k, 12), 16, 10).cast("long").alias(n) for k, n in enumerate(names)]


def _read(label_records: Column, digits: tuple[int, ...], make) -> Column:
    def one(x: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(F.lower(x["value"]), "^\\s*0x", ""), "[^0-9a-z]", "")
        return F.when(bare.rlike("^[0-9a-f]+$") & F.length(bare).isin(*digits), F.struct(F.coalesce(F.lower(reading.strip(x["algo"])), F.lit("")).alias("algo"), *make(bare)))

    return F.array_distinct(F.filter(F.transform(F.filter(label_records, lambda x: x["type"] == "fingerprint"), one), lambda x: x.isNotNull()))


def fingerprints(label_records: Column) -> Column:
    """array<struct<algo, f0, f1, f2>> from label records; values that aren't 36 hexadecimal digits are none."""
    return _read(label_records, (BITS // 4,), lambda bare: packed(bare, BITS))


def digit_values(label_records: Column) -> Column:
    """array<struct<algo, digits>> from label records: hexadecimal values of as many digits as a hash of any size has."""
    return _read(label_records, DIGITS, lambda bare: [bare.alias("digits")])


def _dealt(order: list[int], may_differ: list[int], blocks: dict[int, int]) -> list[list[int]]:
    """The positions of each bucket: bands that may differ in so many values, each in so many blocks; buckets of about one width."""
    sizes = [1 / (blocks[t] - t) for t in may_differ for _ in range(blocks[t])]
    ends = [round(sum(sizes[: k + 1]) / sum(sizes) * len(order)) for k in range(len(sizes))]
    parts = iter([order[a:b] for a, b in zip([0, *ends], ends, strict=False)])
    out = []
    for t in may_differ:
        band = [next(parts) for _ in range(blocks[t])]
        out += [[p for part in kept for p in part] for kept in combinations(band, blocks[t] - t)]
    return out


def bands(width: int, max_bits: int, n_probe: int, n_index: int) -> list[list[int]]:
    """The positions of each bucket of a fingerprint: the cheapest choice for so many rows on the two sides.

    Two fingerprints that differ in at most max_bits agree in all positions of one bucket at least.
    """
    order = list(range(width))
    random.Random(width).shuffle(order)
    best = None
    for b in range(1, min(max_bits + 1, width) + 1):
        less, more = divmod(max_bits + 1, b)
        may_differ = [less] * more + [less - 1] * (b - more)
        kinds = sorted(set(may_differ))
        for cuts in product(*[(1,) if t == 0 else range(t + 1, t + 9) for t in kinds]):
            blocks = dict(zip(kinds, cuts, strict=True))
            if sum(blocks[t] for t in may_differ) > width or sum(comb(blocks[t], t) for t in may_differ) > max(MOST_BUCKETS, max_bits + 1):
                continue
            buckets = _dealt(order, may_differ, blocks)
            cost = (n_probe + n_index) * len(buckets) + VERIFY * n_probe * n_index * sum(2.0 ** -len(x) for x in buckets)
            if best is None or cost < best[0]:
                best = (cost, buckets)
    if best is None or min(map(len, best[1])) < LEAST_BAND and VERIFY * n_probe * n_index < best[0]:
        return [[]]  # buckets so narrow that nearly all pairs meet in several: one bucket, every pair once
    return best[1]


def _masks(width: int, positions: tuple[int, ...] | list[int]) -> list[int]:
    """For each word the bits of these positions (0 is the lowest bit)."""
    out = [0] * len(words(width))
    for p in positions:
        out[-1 - p // WORD] |= 1 << p % WORD
    return out


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def _band_values(width: int, band: list[int]) -> list[Column]:
    return [F.col(n).bitwiseAND(_long(m)) for n, m in zip(words(width), _masks(width, band), strict=True) if m]


def _keys(width: int, buckets: list[list[int]]) -> Column:
    """array<struct<key, band>> of the buckets of a row."""
    return F.array(*[F.struct(F.xxhash64(F.col("algo"), F.lit(k), *_band_values(width, x)).alias("key"), F.lit(k).alias("band")) for k, x in enumerate(buckets)])


def near_pairs(probe: DataFrame, index: DataFrame, max_bits: int, both: list[str] | None = None, width: int = BITS, later_than: str | None = None) -> DataFrame:
    """algo, e0, e1, ... (of probe), t0, t1, ... (of index), bits; columns named in `both` come as e_<c> and t_<c>.

    Each side should hold distinct fingerprints of `width` bits, and be cheap to read twice: its rows are counted first.
    With later_than, a column, only pairs with a greater value on the probing side are kept: each once in a self-join.
    """
    both, names = both or [], words(width)
    buckets = bands(width, max_bits, probe.count(), index.count())
    side = lambda df, s, keys: df.select(F.col("algo").alias(f"{s}_algo"), *[F.col(n).alias(f"{s}{k}") for k, n in enumerate(names)], *[F.col(c).alias(f"{s}_{c}") for c in both], F.inline(keys))
    e, t = side(probe, "e", _keys(width, buckets)), side(index, "t", _keys(width, buckets))
    hot = hot_keys(t, ["key"], BUCKET_ROWS)
    e, t = copied(e, hot, ["key"]), salted(t, hot, ["key"], F.xxhash64(*[f"t{k}" for k in range(len(names))]))
    diff = [F.col(f"e{k}").bitwiseXOR(F.col(f"t{k}")) for k in range(len(names))]
    total = lambda counts: sum(counts[1:], counts[0]) if counts else F.lit(0)
    bits = total([F.bit_count(x) for x in diff])
    inside = [total([F.bit_count(d.bitwiseAND(_long(m))) for d, m in zip(diff, _masks(width, band), strict=True) if m]) for band in buckets]
    first = F.coalesce(*[F.when(x == 0, F.lit(k)) for k, x in enumerate(inside)])
    kept = e.join(t, ["key", "band", "salt__"]).where((F.col("e_algo") == F.col("t_algo")) & (bits <= max_bits) & (F.col("band") == first))
    if later_than:
        kept = kept.where(F.col(f"e_{later_than}") > F.col(f"t_{later_than}"))
    return kept.select(F.col("e_algo").alias("algo"), *[f"{s}{k}" for s in "et" for k in range(len(names))], bits.alias("bits"), *[f"{s}_{c}" for s in "et" for c in both])
