"""Column expressions that read the catalog's dirty strings: JSON, hashes, spellings of splits, modalities, classes.

All are JVM-side expressions; none needs Python workers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings in use.
EMPTY_WORDS = ("", "n/a", "unknown", "-")
SPLIT_SPELLINGS = {
    "train": ("train", "trn", "training"),
    "validation": ("validation", "val", "valid", "dev"),
    "test": ("test", "tst", "testing"),
}
MODALITY_ALIASES = {"图像": "image", "音频": "audio", "文本": "text", "表格": "tabular", "视频": "video", "多模态": "multimodal", "其他": "other"}

LABELS = "array<struct<type:string,class_id:string,class_name:string,name:string,label:string,class_path:string,split:string,algo:string,value:string>>"


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def once(c: Column) -> Column:
    """JSON text that was encoded as a JSON string again, as the inner text; other text as it is."""
    inner = F.get_json_object(F.concat(F.lit("["), c, F.lit("]")), "$[0]")
    return F.when(c.rlike(r'^\s*"'), inner).otherwise(c)


def labels(c: Column) -> Column:
    """Label records; a lone object is a list of one; null where the text is null or does not parse."""
    return F.from_json(once(c), LABELS)


def fields(c: Column) -> Column:
    """Top-level fields of a JSON object as map<string,string>; null where it isn't one."""
    return F.from_json(once(c), "map<string,string>")


def filled(c: Column) -> Column:
    """False for null, an empty array or object, and words that say nothing."""
    word = F.lower(strip(c))
    return c.isNotNull() & ~F.coalesce(word.isin(*EMPTY_WORDS, "[]", "{}") | word.rlike(r"^(\[\s*\]|\{\s*\})$"), F.lit(True))


def content_hash(c: Column) -> Column:
    """The 32 bytes of a sha256 written in any way, else null; all zeros are no hash."""
    bare = F.regexp_replace(F.lower(strip(c)), r"(?U)^[a-z]+-?[0-9]*\s*[:=]\s*|\s+", "")
    ok = bare.rlike("^[0-9a-f]{64}$") & (bare != F.lit("0" * 64))
    return F.when(ok, F.unhex(bare))


def canonical_split(c: Column) -> Column:
    word = F.lower(strip(c))
    out = F.lit(None).cast("string")
    for name, spellings in SPLIT_SPELLINGS.items():
        out = F.when(word.isin(*spellings), name).otherwise(out)
    return out


def recorded_split(label_records: Column, metadata: Column) -> Column:
    """The first filled split in the label records, else that in the metadata, else null."""
    said = F.filter(F.transform(label_records, lambda x: x["split"]), filled)
    meta = metadata["split"]
    return canonical_split(F.coalesce(F.get(said, F.lit(0)), F.when(filled(meta), meta)))


def canonical_modality(c: Column) -> Column:
    word = F.lower(strip(c))
    known = F.create_map(*[F.lit(x) for kv in MODALITY_ALIASES.items() for x in kv])
    return F.coalesce(known[word], word)


def canonical_word(c: Column) -> Column:
    """Lower case, separators as one underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(strip(c)), r"(?U)[\s_\-]+", "_"), "^_+|_+$", "")


def first_class(label_records: Column) -> Column:
    """struct(name, id): of the first classification label: class_name, else name, else label; and class_id."""
    one = F.get(F.filter(label_records, lambda x: x["type"] == "classification"), F.lit(0))
    pick = F.coalesce(*[F.when(filled(one[k]), canonical_word(one[k])) for k in ("class_name", "name", "label")])
    return F.struct(pick.alias("name"), one["class_id"].try_cast("int").alias("id"))


def object_codes(label_records: Column) -> Column:
    """Codes of the objects shown, as longs below zero: two letters and eight digits in the last segment of class_path."""

    def code(x: Column) -> Column:
        last = F.regexp_extract(F.regexp_replace(x["class_path"], r"(?U)[/\\\s]+$", ""), r"([^/\\]*)$", 1)
        bare = F.regexp_replace(F.lower(last), r"(?U)[^\p{L}\p{N}]+", "")
        good = bare.rlike("^[a-z]{2}[0-9]{8}$")
        letters = (F.ascii(F.substring(bare, 1, 1)) - 97) * 26 + F.ascii(F.substring(bare, 2, 1)) - 97
        return F.when(good, -(letters.cast("long") * 100_000_000 + F.substring(bare, 3, 8).try_cast("long") + 1))

    found = F.transform(F.filter(label_records, lambda x: x["type"] == "classification"), code)
    return F.array_distinct(F.filter(found, lambda x: x.isNotNull()))
