"""Text expressions with the meaning that Python's str methods have, on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sedimento.functions.reading import strip

# The stop words, English and Chinese.
STOP_WORDS = (
    "a an and are as at be by for from has he in is it its of on that the to was were will with this these those or not but we you they i "
    "的 了 和 是 在 我 有 就 不 人 都 一 一个 上 也 很 到 说 要 去 你 会 着 没有"
).split()
TOKEN = r"[一-鿿]|[A-Za-z0-9_]+"
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f mentions it (plain columns are copied into lambdas)."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def tokens(c: Column) -> Column:
    """One Chinese character or one ASCII word each; everything else is dropped."""
    return F.regexp_extract_all(c, F.lit(f"({TOKEN})"), F.lit(1))


def lines(c: Column) -> Column:
    """Lines as str.splitlines gives them: no empty one at the end."""
    whole = lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p)
    return F.when(c == "", F.array().cast("array<string>")).otherwise(let(F.split(c, LINE_BREAK), whole))


def first_spellings(units: Column) -> Column:
    """Units without later ones that are equal apart from case; order and first spelling are kept."""
    kept = lambda u: let(F.transform(u, lambda x: F.lower(x)), lambda k: F.filter(u, lambda x, i: F.array_position(k, F.lower(x)) == i + 1))
    return let(units, kept)


def squeeze(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def stem(c: Column) -> Column:
    """The first suffix rule that fits a lower-cased ASCII token long enough for it."""
    return let(F.lower(c), lambda t: _stem(t, c))


def _stem(t: Column, c: Column) -> Column:
    cut = lambda n: F.substring(t, F.lit(1), F.length(t) - n)
    rule = lambda suffix, least: t.endswith(suffix) & (F.length(t) >= least)
    return (
        F.when(~t.rlike("^[a-z0-9_]+$"), c)
        .when(rule("ingly", 7), cut(5)).when(rule("edly", 6), cut(4)).when(rule("ing", 5), cut(3)).when(rule("ed", 4), cut(2))
        .when(rule("ies", 5), F.concat(cut(3), F.lit("y"))).when(rule("es", 4), cut(2)).when(rule("s", 4), cut(1)).otherwise(t)
    )


def human_size(c: Column) -> Column:
    """B, KB, MB or GB with one decimal, in binary steps."""
    x = c.cast("double")
    return (
        F.when(c.isNull(), F.lit("0 B")).when(x < 1024, F.concat(c.cast("bigint").cast("string"), F.lit(" B")))
        .when(x < 1024**2, F.format_string("%.1f KB", x / 1024)).when(x < 1024**3, F.format_string("%.1f MB", x / 1024**2)).otherwise(F.format_string("%.1f GB", x / 1024**3))
    )
