"""Nuclei measured in stacks against those measured one by one."""

import numpy as np

from tessella.operators import segment
from tessella.sources import codec


def spots(n: int) -> np.ndarray:
    rng = np.random.default_rng(9)
    return np.kron(rng.integers(0, 256, (n, 12, 10, 3)), np.ones((1, 5, 5, 1))).astype(float)


def test_measures_of_stacks_equal_those_of_each():
    images = spots(12)
    for profile in (segment.Profile(True, 1, 0.25, 1, 8000), segment.Profile(False, 0, 0.4, 1, 8000, watershed=False)):
        label = segment.stacked(images, profile)
        counts, columns = segment.measures(images, label)
        found = dict(zip((c.split()[0] for c in segment.MEASURES.split(", ")), columns))
        nuclei = [n for image, part in zip(images, label) for n in segment._nuclei(image, part)]
        assert counts.tolist() == [part.max() + 1 for part in label] and counts.sum() == len(nuclei) > 30
        boxes = found["boxes"].to_pylist()
        for k, n in enumerate(nuclei):
            x, y, line = n["x"], n["y"], segment.boundary(n["x"], n["y"])
            assert [found[c][k] for c in ("n", "w", "h", "x0", "x1", "y0", "y1")] == [len(x), n["w"], n["h"], x.min(), x.max(), y.min(), y.max()]
            assert np.allclose([found[c][k] for c in ("mx", "my", "mg", "istd", "light")], [x.mean(), y.mean(), n["gray"].mean(), n["gray"].std(), n["light"]])
            left, top = max(0, x.min() - 2), max(0, y.min() - 2)
            assert boxes[k] == [len(set(zip((x - left) // s, (y - top) // s))) for s in segment.SIZES]
            assert np.allclose([found[c][k] for c in ("area", "perimeter", "hull_area", "hull_perimeter", "points")], [*segment.polygon(line), *segment.polygon(segment.hull(line)), len(line)])
            fit = segment.ellipse(line) if len(line) >= 5 else None
            sides = sorted((int(np.ptp(x)) + 1, int(np.ptp(y)) + 1))
            assert np.allclose([found[c][k] for c in ("cx", "cy", "major", "minor", "angle")], fit or (x.mean(), y.mean(), sides[1], sides[0], 0))


def test_hulls_hold_all_points_at_corners():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 5, 30):
        points = rng.integers(0, 7, (n, 2))
        corners = segment.hull(points)
        assert {tuple(c) for c in corners.tolist()} <= {tuple(p) for p in points.tolist()}
        a, b = corners, np.roll(corners, -1, 0)
        for p in points:
            assert ((b - a)[:, 0] * (p - a)[:, 1] - (b - a)[:, 1] * (p - a)[:, 0] >= 0).all()
    assert segment.hull(np.array([[0, 0], [1, 1], [2, 2], [0, 2], [1, 2]])).tolist() == [[0, 0], [2, 2], [0, 2]]


def test_colours_are_made_once():
    rgb = np.random.default_rng(1).integers(0, 256, (3, 9, 9, 3)).astype(float)
    assert (segment.lab_a_of(rgb) == segment.lab_a(rgb)).all() and (segment.lab_a_of(rgb[:1]) == segment.lab_a(rgb[:1])).all()


def test_no_pixels_of_nuclei_leave_their_task(spark, capsys):
    png = codec.encode_png(spots(1)[0].astype(np.uint8))
    tiles = spark.createDataFrame([(1, png), (2, None), (3, png)], "img long, png binary")
    found = segment.nuclei12(tiles, segment.Profile(True, 1, 0.25, 1, 8000))
    rows = found.collect()
    assert {r["img"] for r in rows} == {1, 3} and sorted(r["inst_id"] for r in rows if r["img"] == 3) == list(range(1, len(rows) // 2 + 1))
    found.explain()
    plan = capsys.readouterr().out
    assert "posexplode" not in plan and "ArrowEvalPython" not in plan and "MapInArrow" in plan
