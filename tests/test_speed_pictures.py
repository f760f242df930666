"""What pictures of pages have in common is worked out once."""

import pickle
import zlib

import numpy as np
from pyspark import cloudpickle

from quire.functions.kept import Kept
from quire.operators import render


def counted(monkeypatch, owner, name):
    """The calls of a function from now on."""
    calls, fn = [], getattr(owner, name)
    monkeypatch.setattr(owner, name, lambda *a, **k: calls.append(a) or fn(*a, **k))
    return calls


def test_what_is_kept_is_bounded_and_never_sent():
    k = Kept(lambda v: v * 2, 3)
    assert [k[v] for v in (1, 2, 3, 4, 1)] == [2, 4, 6, 8, 2] and len(k) == 2
    k = pickle.loads(cloudpickle.dumps(k))
    assert len(k) == 0 and k[5] == 10


def test_pictures_hold_their_rows(monkeypatch):
    rng = np.random.default_rng(1)
    for _ in range(200):
        h, w = rng.integers(1, 50, 2)
        p = np.full((h, w), 255, np.uint8)
        for r in np.flatnonzero(rng.random(h) < 0.4):
            p[r] = rng.integers(0, 256, w)
        assert zlib.decompress(render.deflated(p)) == np.concatenate([np.zeros((h, 1), np.uint8), p], 1).tobytes()


def test_white_rows_are_deflated_once(monkeypatch):
    page = np.full((1667, 1250), 255, np.uint8)
    page[100:120, 7:90] = 0
    render.png(page)
    calls = counted(monkeypatch, render, "blank")
    render.png(page)
    assert not calls
