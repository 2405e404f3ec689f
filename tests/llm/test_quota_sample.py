from sedimento.llm import quota_sample as Q

SCHEMA = "id long, modality string, status string, labels_json string, category int, priority long, n long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)


def targets(spark, rows=((1, "image", "big_one", 0.5, 2), (2, "image", "small", 0.4, 3), (3, "audio", "gone", 0.1, 1))):
    return spark.createDataFrame(list(rows), "class_id int, modality string, class_name string, target_share double, min_rows long")


def lab(**k):
    import json

    return json.dumps([{"type": "fingerprint"}, {"type": "classification", **k}])


def rows(n):
    out = [(i, ["image", "IMAGE ", "图像"][i % 3], "raw", lab(**[{"class_name": "Big One"}, {"name": "big-one", "class_name": "n/a"}, {"class_id": 1}][i % 3])) for i in range(1, n + 1)]
    return out + [(9001, "image", None, lab(label="SMALL")), (9002, "image", "deleted", lab(label="small")), (9003, "text", "raw", None), (9004, None, "raw", "[{"), (9005, "image", "raw", lab(class_name="other")), (None, "image", "raw", lab(label="small"))]


def test_draw_and_report(spark):
    drawn, report = Q.draw_to_targets(frame(spark, rows(996)), targets(spark))
    rep = {r.class_name: r for r in report.collect()}
    assert (rep["big_one"].available, rep["big_one"].quota, rep["big_one"].short) == (996, 50, False)
    assert (rep["small"].available, rep["small"].quota, rep["small"].short) == (1, 1, True)
    assert (rep["gone"].available, rep["gone"].quota, rep["gone"].short) == (0, 0, True)
    got = [r.sample_id for r in drawn.collect()]
    assert len(got) == len(set(got)) == 51 and 9001 in got and 9002 not in got
    assert sorted(got) == sorted(r.sample_id for r in Q.draw_to_targets(frame(spark, rows(996)).repartition(7), targets(spark))[0].collect())


def test_drawn_is_counted(spark):
    got = {r.class_name: r.drawn for r in Q.drawn_report(frame(spark, rows(996)), targets(spark)).collect()}
    assert got == {"big_one": 50, "small": 1, "gone": 0}


def test_categories_gathered_in_one_task_are_read_again(spark, monkeypatch):
    """Rows sorted by class: a task's part of the capacity is too little, and the draw is still the bottom-k of all."""
    t = targets(spark, ((1, "image", "a", 0.6, 1), (2, "image", "b", 0.4, 1)))
    data = [(i, "image", "raw", lab(class_name="a" if i < 3000 else "other")) for i in range(1, 12_001)]
    monkeypatch.setattr(Q, "_room", lambda capacity, part: int(capacity * part))
    one = Q.draw_to_targets(spark.createDataFrame([(*r, 1, 2, 3) for r in data], SCHEMA).repartitionByRange(8, "id"), t)
    got, rep = {r.sample_id for r in one[0].collect()}, {r.class_name: r for r in one[1].collect()}
    monkeypatch.undo()
    want = {r.sample_id for r in Q.draw_to_targets(frame(spark, data).coalesce(1), t)[0].collect()}
    assert got == want and len(want) == 720 == rep["a"].quota and not rep["a"].short and rep["b"].short


def test_uniform(spark):
    hits = [0, 0]
    for seed in range(4):
        for r in Q.draw_to_targets(frame(spark, rows(1000)), targets(spark), seed)[0].where("class_name = 'big_one'").collect():
            hits[r.sample_id > 500] += 1
    assert sum(hits) == 200 and abs(hits[0] - hits[1]) < 60


def test_empty(spark):
    drawn, report = Q.draw_to_targets(frame(spark, []), targets(spark))
    assert drawn.collect() == [] and all(r.short for r in report.collect())
    assert Q.draw_to_targets(frame(spark, rows(10)), targets(spark, [(None, None, None, None, None)]))[1].collect() == []


def test_reservoir_merges_like_one_pass():
    import numpy as np
    import pyarrow as pa

    g = np.random.default_rng(1)
    cat, pr = g.integers(0, 3, 40_000), g.integers(0, 1 << 62, 40_000)
    batches = [pa.RecordBatch.from_arrays([pa.array(cat[i : i + 999].astype(np.int32)), pa.array(np.arange(i, min(i + 999, 40_000))), pa.array(pr[i : i + 999])], ["category", "id", "priority"]) for i in range(0, 40_000, 999)]
    kept = [r for b in Q._reservoirs([50, 0, 20_000], 40_000)(iter(batches)) for r in b.to_pylist() if not r["is_count"]]
    assert {r["id"] for r in kept if r["category"] == 0} == set(np.flatnonzero(cat == 0)[np.argsort(pr[cat == 0])[:50]].tolist())
    assert sum(r["category"] == 1 for r in kept) == 0 and sum(r["category"] == 2 for r in kept) == (cat == 2).sum()
