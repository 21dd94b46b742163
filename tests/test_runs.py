"""Runs are committed whole or not at all."""

import pytest

from hexcadence.sources import runs


@pytest.fixture()
def root(tmp_path):
    return str(tmp_path / "runs")


def frame(spark, n):
    return spark.range(n).selectExpr("id AS k", "CAST(id % 2 AS INT) AS y_pred")


def test_repeated_run_is_one_run(spark, root):
    first = runs.save_run(frame(spark, 10), root, "a", model="m", params={"depth": 3}, metrics={"f2": 0.5}, features=["x"])
    again = runs.save_run(frame(spark, 99), root, "a", model="other")
    assert again == first and first["n_rows"] == 10
    assert runs.read_runs(spark, root).count() == 10
    r = runs.runs(spark, root).first()
    assert (r["model"], r["params"], r["metrics"], r["features"]) == ("m", {"depth": "3"}, {"f2": 0.5}, ["x"])
    runs.save_run(frame(spark, 5), root, "b", model="m")
    assert {(r["run"], r["count"]) for r in runs.read_runs(spark, root).groupBy("run").count().collect()} == {("a", 10), ("b", 5)}
    assert runs.read_runs(spark, root, ["b"]).count() == 5


def test_killed_attempts_are_never_read(spark, root, monkeypatch):
    real = runs._commit
    monkeypatch.setattr(runs, "_commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
    for _ in range(2):
        with pytest.raises(KeyboardInterrupt):
            runs.save_run(frame(spark, 7), root, "a", model="m")
    assert runs.runs(spark, root).count() == 0
    with pytest.raises(ValueError, match="no committed run"):
        runs.read_runs(spark, root)
    monkeypatch.setattr(runs, "_commit", real)
    runs.save_run(frame(spark, 8), root, "a", model="m")
    assert runs.read_runs(spark, root).count() == 8
    assert runs.drop_leftovers(spark, root) == 2 and runs.drop_leftovers(spark, root) == 0
    assert runs.read_runs(spark, root).count() == 8


def test_cut_off_manifest_is_written_anew_and_the_first_commit_wins(spark, root, tmp_path):
    (tmp_path / "runs/manifests").mkdir(parents=True)
    (tmp_path / "runs/manifests/a.json").write_text('{"run": "a", "attempt": "/now')
    assert runs.runs(spark, root).count() == 0
    done = runs.save_run(frame(spark, 4), root, "a", model="m")
    assert done["n_rows"] == 4 and runs.read_runs(spark, root).count() == 4
    runs._commit(spark, root, "a", done | {"n_rows": 77})  # a slower attempt
    assert runs.manifest(spark, root, "a")["n_rows"] == 4


def test_names_and_empty_predictions(spark, root):
    for bad in ("", "a/b", "..", "a b"):
        with pytest.raises(ValueError):
            runs.save_run(frame(spark, 1), root, bad, model="m")
    runs.save_run(frame(spark, 0), root, "none", model="m")
    assert runs.read_runs(spark, root).columns == ["k", "y_pred", "run"] and runs.read_runs(spark, root).count() == 0
