"""Evaluation texts leaking into training text, by pigeonhole pieces and bit-parallel verification.

A passage is any run of `window` words of a test item; it is found where the corpus has it with at most `errors` word
edits. Test items are cut into aligned pieces of p words. Every passage holds at least errors + 1 whole pieces if
p <= (window + 1) / (errors + 2), and so many edits cannot touch them all: one piece stands in the document unchanged.
An Aho-Corasick automaton over all pieces finds exact piece hits in one scan of each text; around a hit, Myers'
bit-parallel distance (over words) verifies the passages that hold the piece.

The items are the query set; their pieces are broadcast, MAX_ITEM_CHARS characters at a time: more items take another
scan of the corpus for each such part. Documents are only streamed: nothing is shuffled, and none is cut or skipped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 13
MAX_ITEM_CHARS = 64_000_000
# Fixed pattern: one Chinese character, or a run of other letters or digits.
WORD = re.compile(r"[一-鿿]|[^\W_一-鿿]+")


def words(text: str | None) -> list[str]:
    return " ".join(WORD.findall(text)).lower().split(" ") if text and WORD.search(text) else []


def piece_length(window: int, errors: int) -> int:
    p = (window + 1) // (errors + 2)
    if p < 1:
        raise ValueError("the window is too short for so many errors")
    return p


def myers(pattern: list[str], text: list[str]) -> list[int]:
    """For each position of text, the edit distance between pattern and the best-matching run that ends there."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, w in enumerate(pattern):
        masks[w] = masks.get(w, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, out = full, 0, m, []
    for w in text:
        eq = masks.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = (mv | ~(xh | pv)) & full, pv & xh
        score += 1 if ph & high else -1 if mh & high else 0
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = (mh | ~(xv | ph)) & full, ph & xv
        out.append(score)
    return out


class Items:
    """The test items, cut into pieces, and the automaton that finds them."""

    def __init__(self, items: list[tuple[int, str]], window: int, errors: int):
        self.window, self.errors, self.p = window, errors, piece_length(window, errors)
        self.words = [(i, w) for i, t in items if len(w := words(t)) >= window]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for k, (_, w) in enumerate(self.words):
            for at in range(0, len(w) - self.p + 1, self.p):
                pieces.setdefault(f" {' '.join(w[at : at + self.p])} ", []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.automaton.add_word(piece, (len(piece), where))
        if pieces:
            self.automaton.make_automaton()
        self.any = bool(pieces)

    def found(self, text: str | None) -> set[int]:
        """Ids of the items of which a passage stands in text."""
        if not text or not self.any:
            return set()
        line = f" {' '.join(WORD.findall(text)).lower()} "
        hits = list(self.automaton.iter(line))
        if not hits:
            return set()
        doc, out, upto, blanks = line.split(), set(), 0, 0
        for first, where in sorted((end - size + 2, where) for end, (size, where) in hits):
            blanks += line.count(" ", upto, first)
            upto, at = first, blanks - 1  # index of the piece's first word
            for k, start in where:
                item, w = self.words[k]
                if item not in out and self._verify(w, start, doc, at):
                    out.add(item)
        return out

    def _verify(self, item: list[str], start: int, doc: list[str], at: int) -> bool:
        for first in range(max(0, start + self.p - self.window), min(start, len(item) - self.window) + 1):
            left = at - (start - first) - self.errors
            region = doc[max(0, left) : at + self.window - (start - first) + self.errors]
            if len(region) >= self.window - self.errors and min(myers(item[first : first + self.window], region)) <= self.errors:
                return True
        return False


def leaks(documents: DataFrame, items: DataFrame, window: int = WINDOW, errors: int = 0) -> DataFrame:
    """doc_id, item_id: documents that hold a passage of a test item, once a pair.

    documents: doc_id, text; items: item_id, text. Words are compared apart from case; everything but letters and digits
    only separates. Items shorter than the window have no passage; null and empty texts match nothing; repeated ids of
    documents are one document, repeated ids of items one item; empty tables give no rows. With errors = 0 a pair
    shares `window` or more consecutive words.
    """
    wanted = items.where("item_id is not null and text is not null").select("item_id", "text")
    chars = wanted.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    parts = -(-chars // MAX_ITEM_CHARS) or 1
    read = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    found = [_scan(read, wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k) if parts > 1 else wanted, window, errors) for k in range(parts)]
    return reduce(DataFrame.unionByName, found).distinct()


def _scan(documents: DataFrame, items: DataFrame, window: int, errors: int) -> DataFrame:
    """doc_id, item_id of items that are few enough to be broadcast."""
    shared = documents.sparkSession.sparkContext.broadcast([(r["item_id"], r["text"]) for r in items.collect()])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Items(shared.value, window, errors)
        for b in batches:
            doc, item = [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for i in index.found(t):
                    doc.append(d)
                    item.append(i)
            if doc:
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(item, pa.int64())], ["doc_id", "item_id"])

    return documents.mapInArrow(scan, "doc_id long, item_id long")


def leak_report(found: DataFrame, items: DataFrame) -> DataFrame:
    """benchmark, split_name, items, leaked_items, documents: how much of each benchmark stands in the corpus."""
    of = items.where("item_id is not null").select("item_id", "benchmark", "split_name").dropDuplicates(["item_id"])
    per = found.groupBy("item_id").agg(F.count("*").alias("n"))
    return of.join(per, "item_id", "left").groupBy("benchmark", "split_name").agg(
        F.count("*").alias("items"), F.count("n").alias("leaked_items"), F.coalesce(F.sum("n"), F.lit(0)).alias("document_hits")
    )
