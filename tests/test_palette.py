"""Median cut against a literal list of boxes."""

import random

import numpy as np
import pytest

from rasterflow.operators import palette


def boxes(colours, size):
    if len(colours) <= size:
        return colours
    found = [colours]
    while len(found) < size:
        sides = [max(max(c[k] for c in b) - min(c[k] for c in b) for k in range(3)) for b in found]
        if not max(sides):
            break
        at = sides.index(max(sides))
        own = found[at]
        axis = next(k for k in range(3) if max(c[k] for c in own) - min(c[k] for c in own) == sides[at])
        own = sorted(own, key=lambda c: c[axis])
        found[at : at + 1] = [own[: len(own) // 2], own[len(own) // 2 :]]
    return [tuple(int(np.floor(sum(c[k] for c in b) / len(b) + 0.5)) for k in range(3)) for b in found]


@pytest.mark.parametrize("span,n,size", [(4, 60, 5), (256, 900, 256), (3, 27, 26), (10, 300, 16), (256, 40, 64), (2, 8, 1), (256, 700, 2)])
def test_cut(span, n, size):
    r = random.Random(n)
    colours = list(dict.fromkeys((r.randrange(span), r.randrange(span), r.randrange(max(1, span // 2))) for _ in range(n)))
    assert [tuple(c) for c in palette.cut(np.array(colours, dtype=np.int64), size).tolist()] == boxes(colours, size)


def test_palettes_of_images(spark):
    rows = [(1, 0, 0, 9, 9, 9), (1, 0, 1, 0, 0, 0), (1, 1, 0, 9, 9, 9), (2, 0, 0, 1, 2, 3), (3, 5, 5, 1, 1, 1), (3, 5, 6, 2, 2, 2), (3, 6, 0, 4, 4, 4)]
    pixels = spark.createDataFrame(rows, "media_id int, y int, x int, r int, g int, b int")
    found = {(r.media_id, r["index"]): (r.r, r.g, r.b) for r in palette.median_cut(pixels).collect()}
    assert found == {(1, 0): (9, 9, 9), (1, 1): (0, 0, 0), (2, 0): (1, 2, 3), (2, 1): (0, 0, 0), (3, 0): (1, 1, 1), (3, 1): (2, 2, 2), (3, 2): (4, 4, 4), (3, 3): (0, 0, 0)}
    assert {(r.media_id, r.y, r.x): r["index"] for r in palette.indexed(pixels).collect()} == {(1, 0, 0): 0, (1, 0, 1): 1, (1, 1, 0): 0, (2, 0, 0): 0, (3, 5, 5): 0, (3, 5, 6): 1, (3, 6, 0): 2}
    assert palette.indexed(pixels.where("r > 100")).count() == 0


def test_nearest_takes_the_last_equal_and_the_first_near():
    own = np.array([[0, 0, 0], [10, 0, 0], [0, 0, 0], [0, 10, 0]])
    assert palette.nearest(np.array([[0, 0, 0], [5, 5, 0], [0, 11, 0]]), own).tolist() == [2, 0, 3]
