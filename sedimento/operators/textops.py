"""Text cleaning: each operator takes texts (id, text) and returns one row for each text with a finding.

Null texts have no finding; an empty text is only found by `text_quality`. All of it stays in JVM expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimento.functions import text as T


def confidence(part: Column, whole: Column) -> Column:
    """A share as a confidence: between 0 and 1, rounded half to even at four places."""
    return F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.0), part.cast("double") / F.greatest(whole, F.lit(1)).cast("double"))), 4)


def _units(texts: DataFrame, units: Column, kept) -> DataFrame:
    """id, t (units), k (what is kept of them), c (how many differ); the generator keeps each text from being cut up again for every use."""
    both = T.let(units, lambda u: T.let(kept(u), lambda k: F.struct(F.size(u).alias("t"), k.alias("k"), F.size(F.filter(F.zip_with(u, k, lambda a, b: a != b), lambda y: y)).alias("c"))))
    return texts.where("text is not null").select("id", F.inline(F.array(both)))


def _finding(df: DataFrame, changed: Column, cleaned: Column) -> DataFrame:
    found = df.select("id", "t", changed.alias("n"), "k").where("n > 0")
    return found.select("id", F.col("n").cast("bigint").alias("changed"), F.col("t").cast("bigint").alias("total"), confidence(F.col("n"), F.col("t")).alias("confidence"), cleaned.alias("cleaned"))


def dedup_lines(texts: DataFrame) -> DataFrame:
    """Repeated lines, apart from case; the cleaned text has the first spelling of each, all white space collapsed."""
    units = F.filter(F.transform(T.lines(F.col("text")), T.strip), lambda u: u != "")
    return _finding(_units(texts, units, T.first_spellings), F.expr("t - size(k)"), T.squeeze(F.array_join("k", "\n")))


def dedup_tokens(texts: DataFrame) -> DataFrame:
    """Repeated tokens, apart from case; the cleaned text joins the first spelling of each with blanks."""
    return _finding(_units(texts, T.tokens(F.col("text")), T.first_spellings), F.expr("t - size(k)"), F.array_join("k", " "))


def remove_stop_words(texts: DataFrame, extra: str | list[str] = "") -> DataFrame:
    """Tokens that are stop words; `extra` words come as a list or with commas between them."""
    more = extra.split(",") if isinstance(extra, str) else extra
    words = F.array(*[F.lit(w) for w in dict.fromkeys([*T.STOP_WORDS, *[w.strip().lower() for w in more if w.strip()]])])
    kept = lambda u: F.filter(u, lambda t: ~F.array_contains(words, F.lower(t)))
    return _finding(_units(texts, T.tokens(F.col("text")), kept), F.expr("t - size(k)"), F.array_join("k", " "))


def stem_tokens(texts: DataFrame) -> DataFrame:
    """Tokens that stemming or lower case changes."""
    return _finding(_units(texts, T.tokens(F.col("text")), lambda u: F.transform(u, T.stem)), F.col("c"), F.array_join("k", " "))


def text_quality(texts: DataFrame, min_length: int = 200) -> DataFrame:
    """id, issue, confidence: blank texts (1.0) and texts shorter than min_length (1 - length / min_length)."""
    x = texts.where("text is not null").select("id", F.length("text").alias("n"), (T.strip(F.col("text")) == "").alias("blank"))
    short = (F.col("n") < min_length) & F.lit(min_length > 0)
    return x.where(F.col("blank") | short).select(
        "id", F.when(F.col("blank"), "empty_text").otherwise("short_text").alias("issue"), F.when(F.col("blank"), 1.0).otherwise(1 - F.col("n") / F.lit(float(max(min_length, 1)))).alias("confidence")
    )


def clean_text(texts: DataFrame, drop_punctuation: bool = False) -> DataFrame:
    """id, cleaned: white space collapsed; with drop_punctuation only letters, digits, underscores and blanks stay."""
    c = F.col("text")
    if drop_punctuation:
        c = F.regexp_replace(c, r"(?U)[^\w\s]+", "")
    return texts.select("id", T.squeeze(c).alias("cleaned"))


def text_meta(texts: DataFrame) -> DataFrame:
    """id, line_count, characters."""
    return texts.where("text is not null").select("id", F.size(T.lines(F.col("text"))).cast("bigint").alias("line_count"), F.length("text").cast("bigint").alias("characters"))


def sentences(texts: DataFrame) -> DataFrame:
    """id, n, sentence: runs that end with a full stop, exclamation or question mark (Chinese, or Western but '.')."""
    # Split behind the marks: a pattern for whole sentences would scan a text without marks once from every character.
    parts = F.filter(F.split("text", "(?<=[。！？!?])"), lambda p: p.rlike("^[^。！？!?]+[。！？!?]$"))
    return texts.where("text is not null").select("id", F.posexplode(parts).alias("n", "sentence")).select("id", F.col("n").cast("bigint").alias("n"), "sentence")


def bigrams(texts: DataFrame) -> DataFrame:
    """id, bigram, n: counts of adjacent characters inside each text, white space apart. Texts of one character have none."""
    characters = F.regexp_extract_all(F.regexp_replace("text", r"(?U)\s+", ""), F.lit("(?s)(.)"), F.lit(1))
    pairs = T.let(characters, lambda c: F.zip_with(F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0))), F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0))), lambda a, b: F.concat(a, b)))
    return texts.where("text is not null").select("id", F.explode(pairs).alias("bigram")).groupBy("id", "bigram").agg(F.count("*").alias("n"))
