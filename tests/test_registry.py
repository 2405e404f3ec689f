import pytest

from sedimento import registry as R
from sedimento.operators import runs as U


def test_parameters():
    p = R.Parameter("strength", "number", 0.5, 0, 1, aliases=("强度",))
    assert p.read({}) == 0.5 and p.read({"强度": "0"}) == 0.0 and p.read({"strength": 1}) == 1.0
    for bad in ({"strength": 2}, {"strength": "x"}):
        with pytest.raises(R.ValidationError):
            p.read(bad)
    with pytest.raises(R.ValidationError):
        R.Parameter("x", "select", "a")
    with pytest.raises(R.ValidationError):
        R.Parameter("x", "colour", "a")


def test_registry_runs_operators(spark):
    r = R.default_registry()
    assert {"image", "multimodal"} >= {o.modality for o in r.listed("cleaning", "image")}
    texts = spark.createDataFrame([(1, "The runs\nthe runs\n"), (2, None)], "id long, text string")
    assert [x.id for x in r.run("text_deduplicate_line", texts).collect()] == [1]
    assert r.run("structure_noise_text_augmenter", texts, target_count=3, perturbation_strength=0.2).count() == 3
    with pytest.raises(R.ValidationError):
        r.run("text_quality", texts, nonsense=1)
    with pytest.raises(R.NotFound):
        r.get("nothing")
    r.set_enabled("text_quality", False)
    with pytest.raises(R.ValidationError):
        r.run("text_quality", texts)
    r.delete("text_quality")
    assert "text_quality" not in r.operators


def test_user_functions(spark, tmp_path):
    f = tmp_path / "mine.py"
    f.write_text("def run(row):\n    return {'id': row['id'], 'n': len(row['text'])} if row['text'] else None\n")
    op = R.row_function(R.load_user_operator(spark, str(f)), "id long, n long")
    assert [(x.id, x.n) for x in op(spark.createDataFrame([(1, "abc"), (2, None)], "id long, text string")).collect()] == [(1, 3)]


def test_parameters_of_user_files(spark, tmp_path):
    f = tmp_path / "grow.py"
    f.write_text(
        "PARAMETERS = [{'name': 'times', 'type': 'int', 'label': 'Times', 'default': '2', 'min': 1, 'max': 5}, {'name': 'mark', 'type': 'select', 'label': 'Mark', 'default': '!', 'options': ['!', '?']}]\n"
        "def run(row):\n    return {'id': row['id'], 'text': row['text'] + row['mark'] * row['times']}\n"
    )
    r = R.Registry()
    R.register_user_operator(r, spark, "grow", str(f), "generation", "text", "id long, text string")
    df = spark.createDataFrame([(1, "a")], "id long, text string")
    assert r.run("grow", df).first().text == "a!!" and r.run("grow", df, times=3, mark="?").first().text == "a???"
    with pytest.raises(R.ValidationError):
        r.run("grow", df, times=9)
    for text, error in (("x = 1", R.ValidationError), ("PARAMETERS = [{'name': 'a'}]", R.ValidationError), ("import no_such_module", R.MissingDependency), ("1 / 0", R.OperatorError)):
        f.write_text(text)
        with pytest.raises(error):
            R.user_parameters(str(f))
    with pytest.raises(R.NotFound):
        R.user_parameters(str(tmp_path / "none.py"))


def test_runs(spark, tmp_path):
    texts = spark.createDataFrame([(1, "The runs\nthe runs\n")], "id long, text string")
    reg = R.default_registry()
    done = U.Run(spark, "r1")
    assert done.operator(reg, "text_deduplicate_line", texts).count() == 1 and (done.status, done.progress) == ("completed", 100.0)
    bad = U.Run(spark, "r2")
    assert bad.operator(reg, "text_quality", texts, nonsense=1) is None and (bad.status, bad.error_code) == ("failed", "VALIDATION_ERROR")
    early = U.Run(spark, "r3")
    assert early.cancel() == "cancelled" and early.log_rows().count() == 1
    with pytest.raises(R.OperatorError):
        early.operator(reg, "text_quality", texts)

    def work(run):
        run.checkpoint(40, "half")
        run.cancel()
        run.checkpoint(60)

    stopped = U.Run(spark, "r4")
    assert stopped.execute(work) is None and (stopped.status, stopped.error_code, stopped.progress) == ("cancelled", "CANCELLED", 60.0)
    levels = [x.level for x in stopped.log_rows().collect()]
    assert levels == ["info", "warning", "warning"]
    rows = U.results(spark.createDataFrame([(1, '{"results":[]}'), (2, "[broken"), (3, '{"metrics":{"a":1}}'), (4, None)], "task_id long, result_json string"))
    assert [(x.task_id, x.model_name, x.metrics_json) for x in rows.collect()] == [(3, "default-evaluator", '{"a":1}')]
    U.write_reports(rows, str(tmp_path / "reports"))
    assert [x.task_id for x in spark.read.json(str(tmp_path / "reports")).collect()] == [3]
    assert U.disk_usage(str(tmp_path))["storage_available"] and not U.disk_usage("/no/such/place")["storage_available"]
