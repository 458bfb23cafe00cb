"""Components over bands of rows, and tasks that run side by side."""

import random

import pytest

from pixelloom.operators import components as K


def brute(cells):
    left, out = set(cells), {}
    while left:
        todo, part = [min(left)], set()
        left.discard(todo[0])
        while todo:
            y, x = todo.pop()
            part.add((y, x))
            for at in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
                if at in left:
                    left.discard(at)
                    todo.append(at)
        first = min(part)
        out |= {at: first[0] * K.WIDE + first[1] for at in part}
    return out


def found(spark, cells, band):
    mask = spark.createDataFrame([(1, y, x) for y, x in cells], "image_id long, y int, x int")
    return {(r.y, r.x): r.component for r in K.components(mask, band=band).collect()}


@pytest.mark.parametrize("band", [1, 3, 4, 64])
def test_bands_of_any_height_give_the_same_components(spark, band):
    draw = random.Random(band)
    cells = [(y, x) for y in range(14) for x in range(11) if draw.random() < 0.58]
    assert found(spark, cells, band) == brute(cells)


def test_rows_at_a_border_may_be_empty(spark):
    above_empty = [(y, x) for y in (0, 1, 2, 4, 5, 8) for x in (0, 1, 4)]  # row 3 ends a band of four
    below_empty = [(y, x) for y in (2, 3, 5, 6) for x in (0, 2, 3)]  # row 4 begins one
    for cells in (above_empty, below_empty):
        assert found(spark, cells, 4) == brute(cells)


def test_no_pixels_have_no_components(spark):
    assert found(spark, [], 4) == {}


def test_tasks_at_once_give_results_in_order(spark):
    count = lambda n: lambda: K.stored(spark.range(n)).count()
    assert K.at_once(spark, *(count(n) for n in (7, 0, 3))) == [7, 0, 3]


def test_nested_tasks_do_not_wait_for_each_other(spark):
    inner = lambda n: lambda: sum(K.at_once(spark, *(lambda k=k: spark.range(k).count() for k in range(n))))
    assert K.at_once(spark, inner(3), inner(4)) == [3, 6]


def test_a_task_that_fails_fails_all(spark):
    def bad():
        raise ValueError("no such raster")

    with pytest.raises(ValueError, match="no such raster"):
        K.at_once(spark, lambda: spark.range(2).count(), bad)


def test_whether_rows_are_there(spark):
    assert K.without_rows(spark.range(0)) and not K.without_rows(spark.range(1))
