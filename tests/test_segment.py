"""Segmentation and outline measures against brute force, closed forms and drawn images."""

import math

import numpy as np
import pytest

from test_analysis import drawn
from tessella.operators import segment
from tessella.sources import codec


def test_distances_and_components_equal_brute_force():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.6, 0.9):
        mask = rng.random((17, 23)) < share
        y, x = np.nonzero(~mask)
        i, j = np.mgrid[:17, :23]
        assert np.allclose(segment.distances(mask), np.sqrt(((i[..., None] - y) ** 2 + (j[..., None] - x) ** 2).min(-1)))
        label, expected, n = segment.labels8(mask), np.zeros(mask.shape, int), 0
        for start in zip(*np.nonzero(mask)):
            if expected[start]:
                continue
            n, todo = n + 1, [start]
            while todo:
                a, b = todo.pop()
                if 0 <= a < 17 and 0 <= b < 23 and mask[a, b] and not expected[a, b]:
                    expected[a, b] = n
                    todo += [(a + p, b + q) for p in (-1, 0, 1) for q in (-1, 0, 1)]
        assert (label == expected).all()
    assert segment.distances(np.ones((3, 4), bool)).min() > 0 and segment.labels8(np.zeros((3, 4), bool)).max() == 0
    spiral = np.zeros((41, 41), bool)
    for k in range(0, 20, 2):
        spiral[k, k : 41 - k] = spiral[40 - k, k : 41 - k] = spiral[k : 41 - k, 40 - k] = True
        spiral[k + 2 : 41 - k, k] = True
        spiral[k + 2, k : k + 3] = True
    assert segment.labels8(spiral).max() == 1


def test_threshold_and_lab():
    gray = np.array([[10] * 6 + [200] * 4])
    assert segment.otsu_level(gray) == 10
    colours = np.array([[[255, 255, 255], [0, 0, 0], [255, 0, 0], [0, 255, 0], [0, 0, 255]]])
    assert segment.lab_a(colours).tolist() == [[128, 128, 208, 42, 207]]
    assert (segment.blurred(np.full((6, 7), 90)) == 90).all() and (segment.blurred(np.full((1, 2), 90)) == 90).all()


def test_outline_of_simple_shapes():
    y, x = map(np.ravel, np.mgrid[5:15, 3:23])
    line = segment.boundary(x, y)
    assert len(line) == 2 * (9 + 19) and segment.polygon(line) == (9 * 19, 2 * (9 + 19))
    assert segment.polygon(segment.hull(line)) == (9 * 19, 2 * (9 + 19))
    assert segment.boundary(np.array([4]), np.array([7])).tolist() == [[4, 7]]
    assert segment.polygon(segment.boundary(np.array([4, 5]), np.array([7, 8])))[0] == 0
    t = np.linspace(0, 2 * math.pi, 60, endpoint=False)
    turn = math.radians(30)
    at = np.stack([40 + 20 * np.cos(t) * math.cos(turn) - 8 * np.sin(t) * math.sin(turn), 50 + 20 * np.cos(t) * math.sin(turn) + 8 * np.sin(t) * math.cos(turn)], 1)
    assert np.allclose(segment.ellipse(at), (40, 50, 40, 16, 30))
    assert segment.ellipse(np.array([[i, 0] for i in range(9)])) is None


def boxes(x, y, left, top, w, h):
    sizes = [s for s in (2, 4, 8, 16, 32) if s < min(w, h)]
    if len(sizes) < 2:
        return 1.0
    n = [len({((j - top) // s, (i - left) // s) for i, j in zip(x, y)}) for s in sizes]
    return min(2.0, max(1.0, np.polyfit(np.log(1 / np.array(sizes)), np.log(n), 1)[0]))


def tiles_of(spark, image):
    blank = codec.encode_png(np.full((32, 32, 3), 200, np.uint8))
    rows = [(1, 0, 0, codec.encode_png(image)), (2, 1, 2, codec.encode_png(image)), (3, 0, 1, blank), (4, 0, 2, None)]
    return spark.createDataFrame(rows, "img long, tile_row int, tile_col int, png binary")


def test_nuclei_by_128_numbers(spark):
    tiles = tiles_of(spark, drawn())
    n = segment.nuclei128(tiles).toPandas()
    a, b = (n[n.img == i].sort_values("cell_id").reset_index(drop=True) for i in (1, 2))
    assert set(n.img) == {1, 2} and a.drop(columns=["img", "tile_row", "tile_col", "feature_vector"]).equals(b.drop(columns=["img", "tile_row", "tile_col", "feature_vector"]))
    for cx, cy, major, minor in ((100, 100, 40, 40), (300, 120, 80, 24)):
        r = a.iloc[((a.centroid_x - cx).abs() + (a.centroid_y - cy).abs()).argmin()]
        assert abs(r.centroid_x - cx) < 1 and abs(r.centroid_y - cy) < 1 and r.major_axis == pytest.approx(major, rel=0.06) and r.minor_axis == pytest.approx(minor, rel=0.08)
        assert r.area == pytest.approx(math.pi * major * minor / 4, rel=0.08) and 0.9 < r.solidity <= 1 and r.bbox_w == pytest.approx(major, abs=3)
    v = np.array(n.feature_vector.tolist())
    assert v.shape[1] == 128 and np.allclose((v**2).sum(1), 1, atol=1e-3)
    assert len(a) >= 3 and a.is_abnormal.any() and not a.is_abnormal.all() and (a.is_abnormal == (a.abnormal_reasons.map(len) >= 2)).all()


def test_nuclei_by_12_numbers(spark):
    image = drawn()
    image[(image[..., 1] < 100)] = (60, 150, 60)  # this profile takes what is less purple than the rest
    tiles = tiles_of(spark, image)
    found = segment.nuclei12(tiles).cache()
    n = found.toPandas()
    assert set(n.img) == {1, 2} and (n[n.img == 1].inst_id.sort_values() == range(1, len(n) // 2 + 1)).all() and len(n) >= 6
    whole = {(r["img"], r["at"] + 1): r["n"] for r in segment.segmented(tiles).collect()}
    gray = np.rint(image @ np.array(segment.LUMA))
    for _, r in n.iterrows():
        p = whole[r.img, r.inst_id]
        x, y = np.array(p["x"]), np.array(p["y"])
        left, top = max(0, x.min() - 2), max(0, y.min() - 2)
        w, h = min(512, x.max() + 3) - left, min(512, y.max() + 3) - top
        assert r.fractal_dim == pytest.approx(boxes(x, y, left, top, w, h), abs=1e-4) and r.intensity_std == pytest.approx(gray[y, x].std(), abs=1e-3)
        assert list(r.bbox) == [x.min() - left, y.min() - top, np.ptp(x) + 1, np.ptp(y) + 1] and list(r.centroid) == [int(x.mean()), int(y.mean())]
        assert r.ecd == pytest.approx(2 * math.sqrt(r.area / math.pi), abs=1e-3) and r.solidity <= 1 <= r.boundary_roughness + 1e-4
        assert len(r.feature_vector) == 12 and 0 <= min(r.feature_vector) and max(r.feature_vector) <= 1 and r.feature_vector[1] == pytest.approx(r.perimeter / 2000, abs=1e-6)
    assert n[(n.area > 1000)].aspect_ratio.max() > 2.5
    t = {r["img"]: (r["total"], r["abnormal"]) for r in segment.results12(tiles, found).collect()}
    assert t[3] == t[4] == (0, 0) and t[1] == t[2] and t[1][0] == len(n) // 2
    one = segment.Profile(True, 2, 0.25, 80, 8000, watershed=False)
    assert segment.segmented(tiles, one).filter("img = 1").count() == 3
    assert segment.nuclei12(tiles.limit(0)).count() == 0


def test_touching_discs_are_parted():
    y, x = np.mgrid[:80, :120]
    mask = ((x - 40) ** 2 + (y - 40) ** 2 <= 400) | ((x - 79) ** 2 + (y - 40) ** 2 <= 400)
    rgb = np.where(mask[..., None], 40, 220) * np.ones(3)
    label = segment.instances(rgb, segment.PY128_SEGMENTS)
    assert label.max() == 1 and label[40, 30] == 0 and label[40, 89] == 1 and ((label >= 0) == mask).mean() > 0.98
    whole = segment.Profile(False, 1, 0.4, 80, 40000, watershed=False)
    assert segment.instances(rgb, whole).max() == 0


def test_stacks_are_as_their_images():
    rng = np.random.default_rng(3)
    images = [np.kron(rng.integers(0, 256, (6, 8, 3)), np.ones((6, 6, 1), int)).astype(float) for _ in range(6)] + [np.full((36, 48, 3), 9.0)] + [rng.integers(0, 256, (36, 48, 3)).astype(float)]
    for profile in (segment.Profile(True, 2, 0.25, 20, 8000), segment.Profile(False, 1, 0.4, 20, 8000), segment.Profile(False, 1, 0.4, 20, 8000, watershed=False)):
        found = segment.stacked(np.stack(images), profile)
        assert found.max() > 0 and (found[6] == -1).all()
        for image, label in zip(images, found):
            assert (segment.instances(image, profile) == label).all()


def test_the_norm_of_a_vector_is_made_once(spark, capsys):
    """Within the division of each number it would be made 128 times a nucleus."""
    segment.nuclei128(spark.createDataFrame([(1, None)], "img long, png binary")).explain()
    plan = capsys.readouterr().out
    assert "array_repeat" in plan
