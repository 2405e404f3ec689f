import random
import time

import pytest

from sedimento.llm import leakage as L

DOCS, ITEMS = "doc_id long, text string, item_id long, w string", "item_id long, text string, benchmark string, split_name string, doc_id long"


def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS)


def items(spark, rows):
    return spark.createDataFrame([(*r, "b", "test", 1) for r in rows], ITEMS)


def ngrams(t, n=13):
    w = L.words(t)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def edit(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        d, old = [i], d
        for j, y in enumerate(b, 1):
            d.append(min(old[j] + 1, d[-1] + 1, old[j - 1] + (x != y)))
    return d[-1]


def test_exact_passages_against_brute_force(spark):
    r = random.Random(5)
    vocab = ["alpha", "Beta", "gam_ma", "ß", "İx", "数", "据集", "x1", "don't", "é"]
    its = [(i, " ".join(r.choice(vocab) for _ in range(r.randrange(8, 40)))) for i in range(20)]
    ds = []
    for i in range(80):
        t = " ".join(r.choice(vocab) for _ in range(30))
        if i % 2:
            words = r.choice(its)[1].split()
            a = r.randrange(len(words))
            t = t[:50] + " " + "\n".join(words[a : a + r.randrange(8, 20)]).upper() + ". " + t[50:]
        ds.append((i, t))
    want = {(d, i) for d, t in ds for i, u in its if ngrams(t) & ngrams(u)}
    got = [(x.doc_id, x.item_id) for x in L.leaks(docs(spark, [*ds, ds[3], (None, ds[1][1]), (900, None), (901, "")]), items(spark, [*its, (99, None), (98, "short")])).collect()]
    assert set(got) == want and len(got) == len(want) and want


def test_edits_against_brute_force():
    r = random.Random(6)
    w = [f"w{i}" for i in range(30)]
    index = L.Items([(1, " ".join(w))], 13, 1)
    for _ in range(200):
        a = r.randrange(0, 17)
        p = w[a : a + 13]
        for _ in range(r.randrange(0, 3)):
            k = r.randrange(len(p))
            p = r.choice([p[:k] + p[k + 1 :], p[:k] + ["new"] + p[k:], p[:k] + ["new"] + p[k + 1 :]])
        text = ["pre"] * 3 + p + ["post"] * 3
        want = any(edit(w[i : i + 13], text[s:e]) <= 1 for i in range(18) for s in range(len(text)) for e in range(s + 12, min(len(text), s + 14) + 1))
        assert (index.found(" ".join(text)) == {1}) == want


def test_myers_and_limits(spark):
    a, b = "k i t t e n".split(), "s i t t i n g".split()
    assert L.myers(a, b)[-1] == min(edit(a, b[i:]) for i in range(len(b) + 1))
    with pytest.raises(ValueError):
        L.piece_length(3, 9)
    assert L.leaks(docs(spark, []), items(spark, [(1, "x " * 20)])).collect() == [] and L.leaks(docs(spark, [(1, "x " * 20)]), items(spark, [])).collect() == []
    long = "pad " * 200_000 + " ".join(f"q{i}" for i in range(13)) + " pad" * 10
    found = L.leaks(docs(spark, [(1, long)]), items(spark, [(7, " ".join(f"Q{i}" for i in range(20)))]))
    assert [(x.doc_id, x.item_id) for x in found.collect()] == [(1, 7)]
    assert [(x.items, x.leaked_items) for x in L.leak_report(found, items(spark, [(7, "a"), (8, "b")])).collect()] == [(2, 1)]


def test_more_items_than_are_broadcast_at_once(spark, monkeypatch):
    its = [(i, " ".join(f"i{i}w{k}" for k in range(20))) for i in range(30)]
    ds = [(i, f"see {its[i][1]} here") for i in range(0, 30, 2)]
    monkeypatch.setattr(L, "MAX_ITEM_CHARS", 400)
    assert sorted((x.doc_id, x.item_id) for x in L.leaks(docs(spark, ds), items(spark, its)).collect()) == [(i, i) for i in range(0, 30, 2)]


def test_many_hits_in_a_long_text_take_linear_time():
    its = [(1, " ".join(f"q{k}" for k in range(20)))]
    index = L.Items(its, 13, 0)
    took = []
    for n in (5_000, 40_000):
        began = time.process_time()
        index.found("q0 q1 q2 q3 q4 q5 q6 stop " * n)
        took.append(time.process_time() - began)
    assert took[1] < 8 * 3 * max(took[0], 0.01)
