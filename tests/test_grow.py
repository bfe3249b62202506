"""Forests grown on all rows: every row counts, splits are the best ones, scores survive saving."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel import schemas as S
from kestrel.operators import grow, ml


def _orders(spark, n, labels=70):
    cats = [f"concat('{c[:2]}', pmod(hash(id, {j}), {labels if j == 2 else 3 + j})) AS {c}" for j, c in enumerate(S.DELAY_CATEGORICALS)]
    nums = [f"CAST(pmod(hash(id, {20 + j}), 40) AS double) AS {c}" for j, c in enumerate(S.DELAY_NUMERICS)]
    late = f"CAST(pmod(hash(id, 20), 40) + pmod(hash(id, 99), 10) > 24 AS int) AS {S.DELAY_TARGET}"
    return spark.range(n).selectExpr("concat('r', id) AS row_key", *cats, *nums, late).localCheckpoint()


def test_models_are_fitted_on_every_training_row(spark, monkeypatch):
    df, seen, real = _orders(spark, 9000), [], ml.grow

    def counted(rows, key, columns, n_rows, *rest):
        seen.append((rows.count(), rows.select("row_hash").distinct().count(), n_rows))
        return real(rows, key, columns, n_rows, *rest)

    monkeypatch.setattr(ml, "grow", counted)
    model, test = ml.train_delay_classifier(df, num_trees=4, max_depth=6)
    ml.train_sales_regressor(df, num_trees=4, max_depth=6)
    assert seen == [(7200, 7200, 7200)] * 2 and test.count() == 1800
    got = ml.eval_classifier(ml.score_delay_batch(model, test), prob="probability").first()
    assert got.accuracy > 0.85 and got.roc_auc > 0.9
    shares = model.stages[-1].featureImportances.toArray()
    assert shares.sum() == pytest.approx(1) and shares.argmax() == 6


def _best(cells, s, labels, min_rows):
    """Largest gain of a node over all features and cuts, by definition."""
    if s.weights is None:
        label, weight = labels, np.ones(len(labels))
    else:
        label = cells[:, 0] % 2
        weight = np.array(s.weights)[label]
    bins = cells // s.classes

    def spread(rows):  # weight times variance; Gini of two classes is twice that
        w = weight[rows]
        return (w * (label[rows] - np.average(label[rows], weights=w)) ** 2).sum() if rows.any() else 0.0

    every, top = np.ones(len(bins), bool), 0.0
    for f, size in enumerate(s.sizes):
        kinds = sorted((b for b in range(size) if (bins[:, f] == b).any()),
                       key=lambda b: b if s.ordered[f] else np.average(label[bins[:, f] == b], weights=weight[bins[:, f] == b]))
        for k in range(1, len(kinds)):
            left = np.isin(bins[:, f], kinds[:k])
            if min(left.sum(), (~left).sum()) >= min_rows:
                top = max(top, spread(every) - spread(left) - spread(~left))
    return top * (1 if s.weights is None else 2)


def _walk(tree, bins, s):
    """Every row's path, a node a level."""
    state, paths = np.zeros(len(bins), np.int64), []
    wide = np.hstack([bins, np.zeros((len(bins), 1), np.int64)])
    for _ in range(s.max_depth + 1):
        paths.append(state)
        seen = wide[np.arange(len(bins)), tree.split_on[state]]
        state = tree.children[state] + ((tree.slots[state, seen >> 6] >> (seen & 63)) & 1)
    return paths


@pytest.mark.parametrize("regression", [False, True])
@pytest.mark.parametrize("chunk", [1 << 17, 64])
def test_splits_are_the_best(monkeypatch, regression, chunk):
    monkeypatch.setattr(grow, "CHUNK", chunk)
    monkeypatch.setattr(grow, "SPAN", 2)
    rng = np.random.default_rng(7)
    sizes = [4, 90, 6, 3]
    bins = np.stack([rng.integers(0, k, 700) for k in sizes], 1)
    value = bins[:, 0] * 2.0 + (bins[:, 1] % 7) + rng.normal(size=700)
    s = grow.Settings(sizes, [True, False, True, False], None if regression else [0.7, 1.9], len(sizes), 5, 5, 3)
    late = (value > 6).astype(int)
    cells = (bins if regression else bins * 2 + late[:, None]).astype(s.cell_type)
    grower = grow.Grower(s, cells, value if regression else None)
    grower.draws = np.ones(1 << 16, np.uint8)  # each row once
    tree = grower.tree(0)
    paths, checked = _walk(tree, bins, s), 0
    for level in range(s.max_depth):
        for node in np.unique(paths[level]):
            rows = paths[level] == node
            best = _best(cells[rows].astype(np.int64), s, value[rows], s.min_rows)
            if tree.split_on[node] == len(sizes):
                assert best < 1e-9
                continue
            went = paths[level + 1][rows]
            labels = value[rows] if regression else late[rows]
            weight = np.ones(len(labels)) if regression else np.array(s.weights)[labels]
            spread = lambda m: (weight[m] * (labels[m] - np.average(labels[m], weights=weight[m])) ** 2).sum()
            gain = (spread(went > 0) - spread(went == went.min()) - spread(went == went.max())) * (1 if regression else 2)
            assert gain == pytest.approx(best, rel=1e-9)
            checked += 1
    assert checked > 10
    for leaf in np.unique(paths[-1]):
        rows = paths[-1] == leaf
        want = value[rows].mean() if regression else (w := np.where(late[rows], 1.9, 0.7))[late[rows] == 1].sum() / w.sum()
        assert tree.slots[leaf, :1].view(np.float64)[0] == pytest.approx(want, rel=1e-9)


def test_draws_are_poisson():
    share = np.bincount(grow._poisson_table(), minlength=4) / (1 << 16)
    assert share[:4] == pytest.approx([0.36788, 0.36788, 0.18394, 0.06131], abs=5e-5)


def test_trees_do_not_depend_on_the_rows_order(spark, tmp_path, monkeypatch):
    df = _orders(spark, 3000)
    bins = ml.binning(df, S.DEMAND_NUMERICS, 32)  # sketches: approximate, so held fixed here
    monkeypatch.setattr(ml, "binning", lambda *rest: bins)
    a, test = ml.train_sales_regressor(df, num_trees=6, max_depth=8)
    b, _ = ml.train_sales_regressor(df.repartition(7, "row_key"), num_trees=6, max_depth=8)
    ml.model_save(a, str(tmp_path / "m"))
    odd = test.withColumn("market", F.when(F.col("sales") > 20, "never seen").otherwise(F.col("market")))
    for rows in (test, odd, test.limit(0)):
        got = [{r.row_key: r.predicted_sales for r in ml.score_demand_batch(m, rows).collect()} for m in (a, b, ml.model_load(str(tmp_path / "m")))]
        assert got[0] == got[1] == got[2]
    assert a.stages[-1].totalNumNodes > 100
