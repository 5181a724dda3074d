import json
import random

import numpy as np
from pyspark.sql import functions as F

from classtilt import rules
from classtilt.operators import audit as aud
from classtilt.operators import knn, tiles
from classtilt.operators import thresholds as thr
from classtilt.sources import readers


def catalogue_item(did, name, values):
    quality = [{"name": n, "value": v} for n, v in values]
    return (json.dumps({"did": did, "name": name, "version": 1, "quality": quality}),)


GOOD = list(zip(rules.CATALOG_QUALITIES, ["500", "3", "50", "100", "6", "5", "1"], strict=True))


def test_catalogue_parses_an_item_once(spark, rows):
    first = [("NumberOfClasses", "2"), *GOOD]  # the last value counts
    broken = [*GOOD, ("NumberOfClasses", "many")]
    data = [catalogue_item(1, "a", first), catalogue_item(2, "b", broken), catalogue_item(3, "c", [*GOOD, ("NumberOfClasses", None)]), ("{",), (None,)]
    got = readers.src_catalog(spark.createDataFrame(data, "item string"))
    assert rows(got, "data_id", "n_classes", "d_raw") == [(1, 3, 5), (3, 3, 5)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1


def test_quota_reads_the_catalogue_once(spark):
    bands = list(rules.BAND_QUOTAS)
    data = [(i, f"set{i}", "mixed" if i % 3 == 0 else "numeric", bands[i % 4]) for i in range(40)]
    seen = spark.sparkContext.accumulator(0)

    def look(i):
        seen.add(1)
        return i

    catalog = spark.createDataFrame(data, "data_id bigint, name string, feature_type string, band string")
    looked = catalog.withColumn("data_id", F.udf(look, "bigint")("data_id"))
    chosen = aud.sel_quota(looked, [1], [], {"numeric": 4, "mixed": 4}, {bands[0]: 3}, 12).collect()
    assert len(chosen) == 12 and seen.value == 40


def test_pivot_distances_stay_in_their_tasks(spark, monkeypatch):
    """Chunks of a group of any number give brute force's neighbours; no joined row carries a list of distances."""

    monkeypatch.setattr(knn, "CHUNK", 16)
    draw = random.Random(3)
    data = [(i, i % 2, [draw.random() * 9], [draw.choice("ab")], 0.5) for i in range(90)]
    rows = spark.createDataFrame(data, "id long, y int, x array<double>, cats array<string>, penalty double")
    near = knn.rs_knn(rows, [], 3, True, penalty="penalty", cell_rows=8, block_rows=8)
    assert "zip_with" not in near._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["id"], r["rank"]): r["nb_id"] for r in near.collect()}
    for i, y, x, c, p in data:
        others = sorted(((x[0] - v[0]) ** 2 + (p * p if c != d else 0), j) for j, z, v, d, _ in data if z == y and j != i)
        assert [got[i, k] for k in (1, 2, 3)] == [j for _, j in others[:3]]


def test_large_groups_get_large_blocks(spark, monkeypatch):
    """Slices of the other side merge to brute force's neighbours."""

    monkeypatch.setattr(tiles, "SLICE", 7)
    draw = random.Random(5)
    data = [(i, i % 2, [draw.choice([0.0, 1.0, 2.0]) for _ in range(5)]) for i in range(60)]
    rows = spark.createDataFrame(data, "id long, y int, x array<double>")
    got = {(r["id"], r["rank"]): r["nb_id"] for r in knn.rs_knn(rows, [], 2, False, block_rows=40).collect()}
    for i, _, x in data:
        others = sorted((sum((a - b) ** 2 for a, b in zip(x, v, strict=True)), j) for j, _, v in data if j != i)
        assert [got[i, k] for k in (1, 2)] == [j for _, j in others[:2]]


def test_codes_tell_only_what_matters():
    """Fewer codes, and the same best place as counting every place of two classes row by row."""

    draw = np.random.default_rng(4)
    p = draw.dirichlet(np.full(5, 0.4), 4000)
    y, o = draw.integers(0, 5, 4000), np.array([0, 2, -1, 3, 0])
    codes = thr._codes(p, y, o, 1, 3, 0.25, 8)
    distinct, n = np.unique(codes, axis=0, return_counts=True)
    assert not distinct[(distinct[:, 0] == 0) | (distinct[:, 1] == 0), 2].any()
    score, _, vector = thr._best_of(distinct, n, o, 1, 3, 8)
    best = 0.0
    for a in range(-8, 9):
        for b in range(-8, 9):
            moved = np.array([0, a, -1, b, 0])
            guess = (p / np.exp(0.25 * moved)).argmax(axis=1)
            hit = [2 * ((guess == k) & (y == k)).sum() / ((guess == k).sum() + (y == k).sum()) for k in range(5)]
            best = max(best, float(np.mean(hit)))
            if vector == moved.tolist():
                assert abs(np.mean(hit) + score) < 1e-9
    assert abs(best + score) < 1e-9
