"""Block products against plain matrices: many blocks and stripes, layers, string ids, ties."""

import numpy as np
import pytest

from stratavox.operators import contrast


@pytest.fixture(params=[(256, 16), (7, 2)])
def small_blocks(request, monkeypatch):
    monkeypatch.setattr(contrast, "BLOCK", request.param[0])
    monkeypatch.setattr(contrast, "STRIPE", request.param[1])


def features(spark, images, places, size=6, seed=0, layers=(None,)):
    """Image 0 holds most positions; its rows repeat a vector, so products tie."""
    rng = np.random.default_rng(seed)
    rows, table = [], {}
    for layer in layers:
        for image in range(images):
            n = places if image == 0 else 3 + image
            q, k = np.round(rng.normal(size=(2, n, size)), 2)
            k[n // 2] = k[0]
            table[layer, image] = q, k
            for side, block in (("q", q), ("k", k)):
                rows += [(layer, side, f"img{image}", pos, v.tolist()) for pos, v in enumerate(block)]
    df = spark.createDataFrame(rows, "layer int, side string, image_id string, pos int, f array<double>")
    return table, df if layers != (None,) else df.drop("layer")


def test_top_keys(spark, small_blocks):
    table, df = features(spark, 4, 61)
    got = {(r["image_id"], r["pos"]): r for r in contrast.pair_similarity(df, top=4).collect()}
    assert len(got) == 61 + 4 + 5 + 6
    for (_, image), (q, k) in table.items():
        dots = q @ k.T
        for pos, row in enumerate(dots):
            r = got[f"img{image}", pos]
            order = sorted(range(len(row)), key=lambda j: (-round(row[j], 9), j))[:4]
            assert (r["n"], [e["key_pos"] for e in r["keys"]]) == (len(row), order)
            assert np.isclose(r["low"], row.min()) and np.isclose(r["high"], row.max())
            assert np.allclose([e["dot"] for e in r["keys"]], row[order])


def test_pairs_above_a_bound(spark, small_blocks):
    table, df = features(spark, 3, 40, seed=1)
    got = {tuple(r)[:4] for r in contrast.similar_pairs(df, 2.5).collect()}
    want = {(f"img{i}", int(a), f"img{i}", int(b)) for (_, i), (q, k) in table.items() for a, b in zip(*np.nonzero(q @ k.T >= 2.5))}
    assert got == want and len(got) > 30


@pytest.mark.parametrize("layers", [(None,), (0, 3)])
def test_loss(spark, small_blocks, layers):
    table, df = features(spark, 3, 45, seed=2, layers=layers)
    got = {tuple(r)[:-1]: r["loss"] for r in contrast.patch_nce(df, temperature=0.5).collect()}
    for (layer, image), (q, k) in table.items():
        logits = q @ k.T / 0.5
        own = np.diag(logits).copy()
        np.fill_diagonal(logits, -10 / 0.5)
        want = np.log(np.exp(own) + np.exp(logits).sum(axis=1)) - own
        for pos, loss in enumerate(want):
            key = (f"img{image}", pos) if layer is None else (layer, f"img{image}", pos)
            assert np.isclose(got.pop(key), loss)
    assert not got


def test_queries_without_an_own_key_have_no_loss(spark):
    _, df = features(spark, 2, 9)
    rows = contrast.patch_nce(df.where("NOT (side = 'k' AND image_id = 'img0' AND pos > 5)")).where("image_id = 'img0'")
    assert sorted(r["pos"] for r in rows.collect()) == [0, 1, 2, 3, 4, 5]


def test_products_stay_in_their_tasks(spark):
    """No interpreted products in the plan, and a large group is dealt to stripes."""
    _, df = features(spark, 2, 30)
    plan = contrast.patch_nce(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "zip_with" not in plan and "aggregate(" not in plan.split("MapInArrow", 1)[1]
