"""Plugins and reports."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from roadweave.operators import policy
from roadweave.sources import reports


def test_plugins(spark):
    @policy.register("constant")
    class Constant:
        name = "constant"

        def score_actions(self, features):
            return pd.Series([2.0] * len(features))

    df = spark.range(5).select(F.col("id").alias("cost"), F.lit(1.0).alias("reward"))
    assert {r["score"] for r in policy.scored(df, "constant", ["cost", "reward"]).collect()} == {2.0}
    assert sorted(round(r["score"], 2) for r in policy.scored(df, "linear", ["cost", "reward"]).collect()) == [0.96, 0.97, 0.98, 0.99, 1.0]
    with pytest.raises(ValueError):
        policy.register("linear")(Constant)
    with pytest.raises(KeyError):
        policy.plugin("none")


def test_learners(spark):
    """A plugin that learns keeps its state in a table; what it says of itself is checked."""
    plugin = policy.learner("running_mean")
    actions = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "od_id int, arm int")
    state = plugin.init(actions)
    assert {r.score for r in plugin.score_actions(actions, state).collect()} == {0.5}
    news = spark.createDataFrame([(1, 0, 1.0), (1, 0, 0.0), (2, 0, None), (3, 5, 1.0)], "od_id int, arm int, reward double")
    both = plugin.update_online(plugin.update_online(state, news), news.where("od_id = 1"))
    assert {(r.od_id, r.arm): (r.pulls, r.total) for r in both.collect()} == {(1, 0): (4, 2.0), (1, 1): (0, 0.0), (2, 0): (0, 0.0), (3, 5): (1, 1.0)}
    assert {(r.od_id, r.arm): r.score for r in plugin.score_actions(actions, both).collect()} == {(1, 0): 0.5, (1, 1): 0.5, (2, 0): 0.5}
    sound = {"name": "other", "version": "1", "supports_online_update": True, "supports_batch_context": False, "init": len, "score_actions": len, "update_online": len}
    for gone in sound:
        with pytest.raises(ValueError):
            policy.register_learner(type("Bad", (), {k: v for k, v in sound.items() if k != gone}))
    with pytest.raises(ValueError):
        policy.register_learner(type("Bad", (), sound | {"name": "running_mean"}))
    with pytest.raises(KeyError):
        policy.learner("none")


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b"), (2, None)], "k int, name string").orderBy("k")
    assert reports.markdown(df).splitlines()[2:] == ["| 1 | a\\|b |", "| 2 |  |"]
    paths = reports.bundle(df, str(tmp_path / "r"))
    assert json.loads((tmp_path / "r.json").read_text()) == [{"k": 1, "name": "a|b"}, {"k": 2, "name": None}]
    assert set(json.loads((tmp_path / "r.manifest.json").read_text())) == set(paths) == {"md", "json", "html", "manifest"}
    reports.map_html(spark.createDataFrame([(0.0, 0.0, 1.0, 1.0, 2.0)], "ax double, ay double, bx double, by double, queue double"), str(tmp_path / "m.html"))
    assert "<line" in (tmp_path / "m.html").read_text()


def test_report_bound(spark, monkeypatch):
    monkeypatch.setattr(reports, "MOST_ROWS", 3)
    with pytest.raises(ValueError):
        reports.markdown(spark.range(10))
