"""Scores that leave one group out against refitting."""

import numpy as np
import pandas as pd
import pytest

from tracklume.functions import skew
from tracklume.operators import group_ridge as GR

SCHEMA = "site string, id long, label int, vec array<double>"


def refitted(x, y, penalty):
    """Centred columns of length one, solved from the normal equations."""
    mean = x.mean(0)
    length = np.linalg.norm(x - mean, axis=0)
    length[length < 1e-9] = 1.0
    z = (x - mean) / length
    w = np.linalg.solve(z.T @ z + penalty * np.eye(x.shape[1]), z.T @ (y - y.mean())) / length
    return w, y.mean() - w @ mean


@pytest.mark.parametrize("limit", [4_000_000, 5])
def test_equal_to_refitting(spark, monkeypatch, limit):
    """A constant column, a group of one row, a third of the rows in one group, and groups that are split into salts."""
    monkeypatch.setattr(skew, "HOT_ROWS", limit)
    monkeypatch.setattr(GR, "_GROUPS_HELD", 2)
    rng = np.random.default_rng(2)
    sites = ["big"] * 30 + [f"s{i}" for i in rng.integers(0, 8, 60)] + ["one"]
    x = rng.normal(1000.0, 1.0, (len(sites), 4))
    x[:, 3] = 7.0
    y = (x[:, 0] + rng.normal(0, 1, len(sites)) > 1000).astype(int)
    rows = [(s, i, int(label), [float(v) for v in row]) for i, (s, label, row) in enumerate(zip(sites, y, x))]
    df = spark.createDataFrame([*rows, (None, 999, 1, [0.0] * 4)], SCHEMA).where("id <> 999")
    got = {r.id: r for r in GR.leave_one_group_out_scores(df, 4, "site", "id", 0.5).collect()}
    assert len(got) == len(sites)
    sites = np.asarray(sites)
    for i, site in enumerate(sites):
        train = sites != site
        w, intercept = refitted(x[train], 2.0 * y[train] - 1, 0.5)
        assert got[i].score == pytest.approx(x[i] @ w + intercept, abs=1e-8)
        assert got[i].truth == y[i] and got[i].pred == int(got[i].score > 0)


def test_no_training_rows(spark):
    one = spark.createDataFrame([("a", 1, 1, [1.0]), ("a", 2, 0, [2.0]), (None, 3, 1, [3.0])], SCHEMA)
    assert GR.leave_one_group_out_scores(one, 1, "site", "id").count() == 0
    assert GR.leave_one_group_out_scores(one.where("id > 9"), 1, "site", "id").count() == 0
    with pytest.raises(ValueError):
        GR.group_weights(one, 513, "site")


def test_a_batch_of_many_groups_is_handed_on_in_small_tables():
    rng = np.random.default_rng(2)
    n, held = 2000, GR._GROUPS_HELD
    batch = pd.DataFrame({"group": np.arange(n) % 900, "label": np.arange(n) % 2, "vec": list(rng.normal(size=(n, 3)))})
    tables = list(GR._group_sums(iter([batch, batch]), np.zeros(3)))
    assert max(len(t) for t in tables) <= held and len({g for t in tables for g in t["group"]}) == 900
    total = sum(np.asarray(p) for t in tables for p in t["part"]).reshape(5, 5)
    assert total[0, 0] == 2 * n and all(isinstance(p, np.ndarray) for p in tables[0]["part"])
