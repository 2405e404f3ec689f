"""Generation: grow a dataset to a target count by augmenting its samples, with seeded and repeatable randomness.

Output i is made from source i mod n. Sources are numbered once; the copies of each are a sequence, so outputs need no
join. Text operators are column expressions where a text is rewritten by fixed rules, and Arrow batches where not.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimento.operators.ranking import numbered

# The word lists of the text operators.
SYNONYMS_ZH = {"好": ["优秀", "良好", "出色"], "坏": ["糟糕", "差", "恶劣"], "大": ["巨大", "庞大", "大型"], "小": ["微小", "细小", "小型"], "快": ["迅速", "快速", "敏捷"], "慢": ["缓慢", "迟缓", "低速"]}
SYNONYMS_EN = {"fast": ["quick", "rapid"], "small": ["compact", "tiny"], "large": ["big", "huge"], "sample": ["example", "instance"]}
PHRASES_ZH = {"提升": ["增强", "改进"], "增强": ["提升", "加固"], "鲁棒性": ["可靠性", "适应性"], "泛化": ["泛化能力", "推广"], "保持": ["维持", "维系"]}
TRANSLATIONS = {
    "好": ["good", "great"], "坏": ["bad", "poor"], "优秀": ["excellent", "great"], "良好": ["good", "fine"], "出色": ["excellent", "outstanding"], "差": ["bad", "poor"],
    "大": ["big", "large"], "巨大": ["huge", "massive"], "小型": ["small-scale", "small"], "小": ["small", "tiny"], "微小": ["tiny", "minute"], "快": ["fast", "quick"],
    "迅速": ["rapid", "quick"], "快速": ["quick", "rapid"], "慢": ["slow", "sluggish"], "缓慢": ["slow", "gradual"], "迟缓": ["slow", "delayed"],
    "提升": ["improve", "enhance"], "增强": ["enhance", "boost"], "鲁棒性": ["robustness", "reliability"], "泛化": ["generalization"], "保持": ["maintain", "preserve"],
}
FORMAL = (("搞", "进行"), ("挺", "相当"), ("很", "较为"), ("非常", "十分"), ("特别", "尤其"), ("可能", "或许"), ("感觉", "认为"))
CASUAL = (("进行", "搞"), ("相当", "挺"), ("较为", "挺"), ("十分", "很"), ("尤其", "特别"), ("或许", "可能"), ("认为", "觉得"))
CONCISE_DROPS = ("其实", "可能", "感觉", "大概", "大致", "非常", "真的", "挺")
CONCISE_SWAPS = (("并且", "且"), ("同时", "且"))
NOISE_CHARS = "的一是在不了有和人这中大为上个国我以要到时由业也能下去向你，。！？；：、"
NOISE_MARKS = {"，": "、", "。": "！", "！": "。", "？": "！", "；": "，", "：": "；"}


class InsufficientOutputs(ValueError):
    code = "INSUFFICIENT_OUTPUTS"


def round_robin(sources: DataFrame, target: int, key: str = "id") -> DataFrame:
    """sources with i for each output: i runs from 0 to target - 1 and its source is number i mod n in order of key."""
    x = numbered(sources.where(F.col(key).isNotNull()), [], [F.col(key)])
    last = F.floor((F.lit(target) - F.col("rn")) / F.col("n"))
    x = x.where(F.col("rn") <= target).withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"))))
    return x.withColumn("i", F.col("rn") - 1 + F.col("k") * F.col("n")).drop("rn", "n", "k")


def output_name(name: Column, tag: str, i: Column) -> Column:
    return F.concat(F.regexp_replace(name, r"(\.[^./]+)$", ""), F.lit(f"_{tag}_"), F.format_string("%04d", i), F.regexp_extract(name, r"(\.[^./]+)$", 1))


def copies(sources: DataFrame, target: int) -> DataFrame:
    """i, source_sample_id, name of plain copies."""
    return round_robin(sources, target).select("i", F.col("id").alias("source_sample_id"), output_name(F.col("name"), "copy", F.col("i")).alias("name"))


def complete(outputs: DataFrame, target: int) -> DataFrame:
    """outputs if there are at least target of them, cut to that; else nothing is kept and InsufficientOutputs raised."""
    n = outputs.count()
    if n < target:
        raise InsufficientOutputs(f"{n} of {target} outputs")
    return outputs.where(F.col("i") < target) if n > target else outputs


def inherit_labels(outputs: DataFrame, sources: DataFrame) -> DataFrame:
    """outputs (id, source_sample_id, labels_json) with labels_json from the source where they have none; labels_inherited says so."""
    of = sources.select(F.col("id").alias("source_sample_id"), F.col("labels_json").alias("from__"))
    own = F.coalesce(~F.trim("labels_json").isin("", "[]", "null"), F.lit(False))
    x = outputs.join(of, "source_sample_id", "left")
    return x.withColumn("labels_inherited", ~own & F.col("from__").isNotNull()).withColumn("labels_json", F.when(own, F.col("labels_json")).otherwise(F.col("from__"))).drop("from__")


def replace_words(c: Column, words: dict[str, list[str]], ratio: float = 1.0, seed: Column | None = None) -> Column:
    """Unicode words joined by blanks, those in the list replaced: the first candidate, or by seed with this probability."""
    known = F.create_map(*[x for k, v in words.items() for x in (F.lit(k), F.array(*[F.lit(y) for y in v]))])
    units = F.regexp_extract_all(c, F.lit(r"(?U)(\b\w+\b)"), F.lit(1))

    def one(w: Column, i: Column) -> Column:
        options = known[F.lower(w)]
        if seed is None:
            return F.coalesce(options[0], w)
        draw = F.pmod(F.xxhash64(seed, i), F.lit(1_000_003))
        return F.when(options.isNotNull() & (draw < F.lit(int(1_000_003 * ratio))), F.element_at(options, (F.pmod(draw, F.size(options)) + 1).cast("int"))).otherwise(w)

    return F.array_join(F.transform(units, one), " ")


def replace_chain(c: Column, pairs: list[tuple[str, str]]) -> Column:
    """One replacement after the other, each of all occurrences."""
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _longest_first(words: dict[str, list[str]]) -> list[str]:
    return sorted(words, key=len, reverse=True)


def phrases(c: Column) -> Column:
    """The first candidate of each phrase of the list, longer ones first, then of each word, everywhere and in turn."""
    return replace_chain(c, [(k, PHRASES_ZH[k][0]) for k in _longest_first(PHRASES_ZH)] + [(k, v[0]) for k, v in SYNONYMS_ZH.items()])


def formal(c: Column) -> Column:
    return replace_chain(c, list(FORMAL))


def casual(c: Column) -> Column:
    return replace_chain(c, list(CASUAL))


def concise(c: Column) -> Column:
    return replace_chain(c, [(w, "") for w in CONCISE_DROPS] + list(CONCISE_SWAPS))


# ---- operators that need more than expressions: text x generator -> text ---------------------------------------------


def structure_noise(t: str, g: np.random.Generator, strength: float = 0.1) -> str:
    """max(1, strength x length) edits: delete, insert a common character, swap neighbours, or change a mark or add a blank."""
    s = list(t)
    for _ in range(max(1, int(len(t) * strength))):
        if len(s) <= 1:
            break
        kind, i = int(g.integers(4)), int(g.integers(len(s)))
        if kind == 0:
            del s[i]
        elif kind == 1:
            s.insert(i, NOISE_CHARS[int(g.integers(len(NOISE_CHARS)))])
        elif kind == 2:
            i = min(i, len(s) - 2)
            s[i : i + 2] = s[i + 1], s[i]
        elif s[i] in NOISE_MARKS:
            s[i] = NOISE_MARKS[s[i]]
        elif g.random() < 0.3:
            s.insert(i, " ")
    return "".join(s)


def vocabulary_phrase(t: str, g: np.random.Generator, ratio: float = 0.3, phrase: bool = True) -> str:
    """Each phrase and word of the lists that occurs is replaced everywhere, with this probability, by one of its candidates."""
    for words, keys in ((PHRASES_ZH, _longest_first(PHRASES_ZH) if phrase else []), (SYNONYMS_ZH, list(SYNONYMS_ZH))):
        for k in keys:
            if k in t and g.random() < ratio:
                t = t.replace(k, words[k][int(g.integers(len(words[k])))])
    return t


def reorder_sentences(t: str, g: np.random.Generator, strength: float = 0.5, granularity: str = "sentence", keep_ends: bool = True) -> str:
    """Shuffles a share of the sentences or paragraphs; first and last stay unless told otherwise."""
    units = re.findall(r"[^。！？!?.]+[。！？!?.]?\s*", t) if granularity == "sentence" else re.split(r"(?:\r?\n){2,}", t)
    inner = list(range(1, len(units) - 1)) if keep_ends else list(range(len(units)))
    moved = sorted(g.choice(inner, size=int(len(inner) * strength), replace=False).tolist()) if inner else []
    to = list(moved)
    g.shuffle(to)
    out = list(units)
    for a, b in zip(moved, to, strict=True):
        out[a] = units[b]
    return ("" if granularity == "sentence" else "\n\n").join(out)


def context_swap(t: str, g: np.random.Generator, mask_ratio: float = 0.1, words: dict[str, list[str]] | None = None) -> str:
    """Replaces a share of the listed characters by the synonym that fits best: the most likely with its neighbours under
    add-one counts of adjacent characters of the text, white space apart."""
    words = words or SYNONYMS_ZH
    where = [i for i, c in enumerate(t) if c in words]
    if not where:
        return t
    bare = re.sub(r"\s+", "", t)
    pairs = Counter(map("".join, zip(bare, bare[1:], strict=False)))
    total = max(1, sum(pairs.values()))
    out = list(t)
    picked = g.choice(where, size=min(len(where), max(1, int(len(where) * mask_ratio))), replace=False)
    for i in picked.tolist():
        before = next((c for c in reversed(out[:i]) if c not in " \n\t\r"), "")
        after = next((c for c in out[i + 1 :] if c not in " \n\t\r"), "")

        def fit(w: str) -> float:
            run = (before[-1:] if before else "") + w + after[:1]
            return sum(math.log((pairs[run[k : k + 2]] + 1) / (total + 1)) for k in range(len(run) - 1))

        out[i] = max(words[out[i]], key=fit)
    return "".join(out)


def back_translation(t: str, g: np.random.Generator, probability: float = 1.0, restructure: float = 0.3) -> str:
    """Into the second language and back through a small dictionary, so that words come back as others; then, with the
    probability `restructure`, the inner clauses change places. A text that was translated has no white space left."""
    pick = lambda options: options[int(g.integers(len(options)))]
    if g.random() <= probability:
        for word in _longest_first(TRANSLATIONS):
            if word in t:
                t = t.replace(word, f" {pick(TRANSLATIONS[word])} ")
        back: dict[str, list[str]] = {}
        for word, there in TRANSLATIONS.items():
            for x in there:
                back.setdefault(x, []).append(word)
        t = re.sub("[A-Za-z]+", lambda m: pick(back[m[0].lower()]) if m[0].lower() in back else m[0], t)
        t = re.sub(r"\s+", "", t)
    if g.random() < restructure:
        parts = re.split("([，；。！？])", t)
        inner = list(range(2, len(parts) - 2, 2))
        to = g.permutation(inner).tolist()
        moved = list(parts)
        for a, b in zip(inner, to, strict=True):
            moved[a] = parts[b]
        t = "".join(moved)
    return t


def styled(t: str, g: np.random.Generator, style: str = "concise", strength: float = 0.5) -> str:
    """formal and casual by rules that each apply with 0.8, casual with a filler behind all commas half of the time;
    concise drops filler words with the given strength and shortens conjunctions."""
    for a, b in {"formal": FORMAL, "casual": CASUAL}.get(style, ()):
        if a in t and g.random() < 0.8:
            t = t.replace(a, b)
    if style == "casual" and g.random() < 0.5:
        t = t.replace("，", "，真的，")
    if style == "concise":
        for w in CONCISE_DROPS:
            if w in t and g.random() < strength:
                t = t.replace(w, "")
        for a, b in CONCISE_SWAPS:
            t = t.replace(a, b)
    return t


TEXT_OPERATORS: dict[str, Callable[..., str]] = {"structure_noise": structure_noise, "vocabulary_phrase": vocabulary_phrase, "sentence_reordering": reorder_sentences, "context_embedding": context_swap, "back_translation": back_translation, "style_controlled": styled}


def augment_text(sources: DataFrame, target: int, operator: str, seed: int = 0, **params: object) -> DataFrame:
    """i, source_sample_id, text of `target` outputs made from sources (id, text); null texts are no sources.

    The generator of an output is seeded by seed, source and i: results do not depend on partitions or retries.
    """
    op = TEXT_OPERATORS[operator]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [op(t, np.random.default_rng(zlib.crc32(f"{seed}/{s}/{i}".encode())), **params) for t, s, i in zip(b["text"], b["id"], b["i"], strict=True)]
            yield pd.DataFrame({"i": b["i"], "source_sample_id": b["id"], "text": texts})

    return round_robin(sources.where("text is not null").select("id", "text"), target).select("i", "id", "text").mapInPandas(run, "i long, source_sample_id long, text string")


