"""Stencils along z in windows with ghost slices: the cut must not show."""

import numpy as np
import pytest
from helpers import plane_rows

from stratavox.operators import pairing, planes
from stratavox.operators.layout import x_windows


def volumes(spark, depth, height=3, width=21, seed=0):
    rng = np.random.default_rng(seed)
    a = rng.random((depth, height, width)) * 2 - 1
    b = np.clip(a + rng.normal(0, 0.3, a.shape), -1, 1)
    return a, b, pairing.slice_pairs(plane_rows(spark, list(a), 7), plane_rows(spark, list(b), 7))


def whole(spark, a, b, win):
    """The planes (Z, Y) of each x as images of one row each."""
    sides = [plane_rows(spark, [v[:, x] for x in range(v.shape[1])]) for v in (a, b)]
    got = planes.ms_ssim(pairing.slice_pairs(*sides), win=win).orderBy("z").collect()
    return [r["ms_ssim"] for r in got]


@pytest.mark.parametrize("depth", [32, 33, 38, 45])
@pytest.mark.parametrize("rows", [1, 5, 16, 1000])
def test_score_does_not_depend_on_the_windows(spark, depth, rows):
    a, b, pairs = volumes(spark, depth)
    got = planes.ms_ssim_depth(pairs, win=5, rows=rows).orderBy("x").collect()
    assert [r["x"] for r in got] == [0, 1, 2]
    assert np.allclose([r["ms_ssim"] for r in got], whole(spark, a, b, 5), rtol=1e-12)


def test_windows_hold_their_ghosts_and_no_more(spark):
    _, _, pairs = volumes(spark, 50)
    got = x_windows(pairs, 10, 3, ("a",)).where("x = 1").orderBy("window").collect()
    assert [(r["z_from"], r["h"]) for r in got] == [(0, 13), (7, 16), (17, 16), (27, 16), (37, 13)]
    assert all(len(r["a"]) == r["h"] * r["w"] for r in got)


def test_scored_windows_have_only_the_neighbours_of_halving_below(spark, monkeypatch):
    _, _, pairs = volumes(spark, 30)
    made = []
    monkeypatch.setattr(planes, "x_windows", lambda *args, **named: made.append(x_windows(*args, **named)) or made[-1])
    planes.ms_ssim_depth(pairs, win=5, rows=8, weights=planes.MS_WEIGHTS[:3])
    got = made[0].where("x = 1").orderBy("window").collect()
    assert [(r["z_from"], r["h"]) for r in got] == [(0, 30), (0, 30), (8, 22), (16, 14)]


def test_missing_slice_is_an_error(spark):
    _, _, pairs = volumes(spark, 12)
    with pytest.raises(Exception, match="missing"):
        x_windows(pairs.where("z <> 5"), 4, 1, ("a",)).collect()


def test_planes_smaller_than_the_window_have_no_score(spark):
    _, _, pairs = volumes(spark, 6)
    assert [r["ms_ssim"] for r in planes.ms_ssim_depth(pairs, win=5, rows=4).collect()] == [None] * 3
