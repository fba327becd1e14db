import os
from collections import defaultdict

import pytest

from terrastack.operators import retrieval
from terrastack.params import ForestParams
from terrastack.plans import queries
from terrastack.schemas import FEATURES, LABEL

DATA = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def nodes(root):
    """A tree as nested tuples: (feature, threshold, left, right), or a leaf's value."""
    if root.getClass().getSimpleName() == "LeafNode":
        return root.prediction()
    return root.split().featureIndex(), root.split().threshold(), nodes(root.leftChild()), nodes(root.rightChild())


def walk(tree, features):
    while isinstance(tree, tuple):
        feature, threshold, left, right = tree
        tree = left if features[feature] <= threshold else right
    return tree


def test_every_clear_observation_by_a_walk_of_the_forest_of_its_key(spark, monkeypatch):
    """All (sensor, biome) keys are trained, with default features and leaves; no observation is lost, and each value is the mean of a plain walk through the trees of its own key."""
    asked, models = [], {}
    train = retrieval.train

    def fewer(samples, key=None, params=None, features=None):
        asked.append((key, params, features))
        models[key] = train(samples, key, ForestParams(trees=6, min_leaf=4), features)
        return models[key]

    monkeypatch.setattr(retrieval, "train", fewer)
    found = {(r.scene_id, r.pixel_id): [] for r in queries.forest_rows(spark, DATA).select("scene_id", "pixel_id").collect()}
    for r in queries.rf_regression(spark, DATA).collect():
        found[r.scene_id, r.pixel_id].append((round(r.lai_real, 6), round(r.MCD_LAI, 6)))
    rows = queries.forest_rows(spark, DATA).collect()
    keys = {(r.sensor, r.biome) for r in rows}
    assert {a[0] for a in asked} == keys and len(asked) == len(keys) > 3
    assert all(a[1:] == (ForestParams(), FEATURES) for a in asked)
    forests = {key: [nodes(t._call_java("rootNode")) for t in model.trees] for key, model in models.items()}
    assert any(isinstance(t, tuple) for f in forests.values() for t in f)
    wanted = defaultdict(list)
    for r in rows:
        values = [walk(tree, [r[f] for f in FEATURES]) for tree in forests[r.sensor, r.biome]]
        wanted[r.scene_id, r.pixel_id].append((sum(values) / len(values), r.MCD_LAI))
    assert found.keys() == wanted.keys()
    for key, pairs in wanted.items():
        assert sorted(found[key]) == [pytest.approx(p, abs=2e-6) for p in sorted(pairs)]


def test_biome_0_and_pooled_forests_learn_from_all_biomes(spark):
    samples = queries.forest_rows(spark, DATA).where("sensor = 'LC08'").persist()
    sizes = []
    for key, params in ((("LC08", 0), ForestParams(trees=1)), (("LC08", 5), ForestParams(trees=1)), (("LC08", 5), ForestParams(trees=1, pool_biomes=True))):
        tree = retrieval.train(samples, key, params).trees[0]
        sizes.append(tree._call_java("rootNode").impurityStats().count())
    assert sizes[1] < sizes[2] == sizes[0]
    samples.unpersist()


def test_rows_of_a_large_key_are_dealt_evenly_to_tasks_and_large_forests_are_fitted_alone(spark, monkeypatch):
    """One file of a key was one task before, however many rows it had, and any four forests were in memory together."""
    seen, running, together = {}, set(), {}

    def sizes(samples, key=None, params=None, features=None):
        running.add(key)
        together[key] = max(len(running), together.get(key, 0))
        seen[key] = samples.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
        running.remove(key)
        return key

    monkeypatch.setattr(retrieval, "train", sizes)
    monkeypatch.setattr(retrieval, "TASK_ROWS", 500, raising=False)
    monkeypatch.setattr(retrieval, "ALONE_ROWS", 2000, raising=False)
    rows = [("LC08", 1)] * 3900 + [("LC08", 2)] * 700 + [("LE07", 1)] * 300
    named = [(*key, *[float(i)] * (len(FEATURES) + 1)) for i, key in enumerate(rows)]
    frame = spark.createDataFrame(named, ", ".join(["sensor string", "biome2 int", *(f"{name} double" for name in [*FEATURES, LABEL])]))
    keys = [("LC08", 0), ("LC08", 1), ("LC08", 2), ("LE07", 1)]
    found = retrieval.train_all(frame, keys)
    assert list(found) == keys and all(found[k] == k for k in keys)
    assert {k: sum(v) for k, v in seen.items()} == {("LC08", 0): 4600, ("LC08", 1): 3900, ("LC08", 2): 700, ("LE07", 1): 300}
    assert all(max(v) <= 510 for v in seen.values())
    assert together["LC08", 0] == together["LC08", 1] == 1
