import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.functions import pixels

POINTS = st.lists(st.tuples(st.integers(-20, 20), st.integers(-20, 20)), min_size=3, max_size=30).map(lambda p: np.array(p, float))


@settings(deadline=None, max_examples=60)
@given(POINTS)
def test_hull_holds_all_points(points):
    hull = pixels.convex_hull(points)
    assert {tuple(p) for p in hull.tolist()} <= {tuple(p) for p in points.tolist()}
    if len(hull) >= 3:
        sides = np.roll(hull, -1, axis=0) - hull
        turns = sides[:, None, 0] * (points[None, :, 1] - hull[:, None, 1]) - sides[:, None, 1] * (points[None, :, 0] - hull[:, None, 0])
        assert (turns >= -1e-9).all()


@settings(deadline=None, max_examples=60)
@given(POINTS)
def test_quad_is_a_rectangle_around_the_points(points):
    quad = pixels.min_area_quad(points)
    if len(pixels.convex_hull(points)) < 3:
        return
    u, v = quad[1] - quad[0], quad[3] - quad[0]
    assert abs(u @ v) < 1e-6 * max(1, np.linalg.norm(u) * np.linalg.norm(v))
    for axis in (u, v):
        at = (points - quad[0]) @ axis
        assert at.min() >= -1e-6 and at.max() <= axis @ axis + 1e-6
    assert abs(pixels.signed_area(quad)) <= np.ptp(points[:, 0]) * np.ptp(points[:, 1]) + 1e-6


def test_unclip_of_a_rectangle():
    quad = np.array([[0, 0], [100, 0], [100, 20], [0, 20]], float)
    grown = pixels.unclip(quad)
    assert np.allclose([grown.min(), grown[:, 0].max(), grown[:, 1].max()], [-35 / 3, 100 + 35 / 3, 20 + 35 / 3])
    assert np.allclose(sorted(map(tuple, pixels.unclip(quad[::-1]))), sorted(map(tuple, grown)))
    flat = np.array([[0, 0], [5, 0], [5, 0], [0, 0]], float)
    assert (pixels.unclip(flat) == flat).all()


def test_contours_of_a_box_with_a_hole():
    mask = np.zeros((12, 14), bool)
    mask[2:10, 3:11] = True
    mask[5:7, 6:8] = False
    found = pixels.contours(mask)
    assert len(found) == 2
    outer, hole = found
    assert (outer.min(axis=0) == [2, 1]).all() and (outer.max(axis=0) == [9, 8]).all() and len(outer) == 28
    assert (hole.min(axis=0) == [4, 3]).all() and (hole.max(axis=0) == [7, 6]).all()


def test_contours_single_pixel_and_many():
    mask = np.zeros((5, 9), bool)
    mask[2, 2] = mask[2, 6] = True
    assert [c.tolist() for c in pixels.contours(mask)] == [[[1.0, 1.0]], [[5.0, 1.0]]]


@settings(deadline=None, max_examples=40)
@given(st.integers(0, 2**32 - 1))
def test_contours_cover_border_pixels(seed):
    mask = np.pad(np.random.default_rng(seed).random((7, 9)) < 0.5, 1)
    traced = {(int(x) + 1, int(y) + 1) for c in pixels.contours(mask) for x, y in c}
    for y, x in np.argwhere(mask).tolist():
        open_side = not (mask[y - 1, x] and mask[y + 1, x] and mask[y, x - 1] and mask[y, x + 1])
        assert ((x, y) in traced) >= open_side
    assert all(mask[y, x] for x, y in traced)


def followed(mask):
    """Border following pixel by pixel (Suzuki and Abe, 1985): outer and hole borders."""
    around = [(1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)]  # clockwise from the right
    f, found, border = mask.astype(int), [], 1
    for y, x in np.argwhere(mask).tolist():
        if f[y, x] == 1 and not f[y, x - 1]:
            back = 4
        elif f[y, x] >= 1 and not f[y, x + 1]:
            back = 0
        else:
            continue
        while True:  # a pixel may begin an outer and then a hole border
            border += 1
            first = next((k % 8 for k in range(back, back + 8) if f[y + around[k % 8][1], x + around[k % 8][0]]), None)
            points = [(x, y)]
            if first is None:
                f[y, x] = -border
            else:
                end, here, toward = (x + around[first][0], y + around[first][1]), (x, y), first
                while True:
                    k, right_is_empty = toward - 1, False
                    while not f[here[1] + around[k % 8][1], here[0] + around[k % 8][0]]:
                        right_is_empty |= k % 8 == 0
                        k -= 1
                    if right_is_empty:
                        f[here[1], here[0]] = -border
                    elif f[here[1], here[0]] == 1:
                        f[here[1], here[0]] = border
                    ahead = (here[0] + around[k % 8][0], here[1] + around[k % 8][1])
                    if ahead == (x, y) and here == end:
                        break
                    here, toward = ahead, (k + 4) % 8
                    points.append(here)
            found.append(points)
            if back == 4 and f[y, x] >= 1 and not f[y, x + 1]:
                back = 0
                continue
            break
    return [[(a - 1, b - 1) for a, b in p] for p in found]


@settings(deadline=None, max_examples=300)
@given(st.integers(1, 12), st.integers(1, 12), st.sampled_from([0.1, 0.3, 0.5, 0.7, 0.9]), st.integers(0, 2**32 - 1))
def test_contours_equal_border_following(h, w, share, seed):
    mask = np.pad(np.random.default_rng(seed).random((h, w)) < share, 1)
    assert [[tuple(p) for p in c.astype(int).tolist()] for c in pixels.contours(mask)] == followed(mask)


@settings(deadline=None, max_examples=100)
@given(st.lists(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 20)), min_size=1, max_size=25), min_size=1, max_size=6))
def test_shapes_together_equal_shapes_alone(groups):
    points = np.array([p for g in groups for p in g], float)
    hulls, counts = pixels.convex_hulls(points, np.repeat(np.arange(len(groups)), [len(g) for g in groups]), len(groups))
    for own, hull in zip(groups, np.split(hulls, np.cumsum(counts)[:-1]), strict=True):
        assert hull.tolist() == pixels.convex_hull(np.array(own, float)).tolist()
    quads = pixels.min_area_quads(hulls, counts)
    for own, quad, grown in zip(groups, quads, pixels.unclip_all(quads), strict=True):
        assert np.allclose(quad, pixels.min_area_quad(np.array(own, float)))
        assert np.allclose(grown, pixels.unclip(quad))
        if abs(pixels.signed_area(quad)) > 1e-6:
            sides = [np.linalg.norm(q[1] - q[0]) * np.linalg.norm(q[2] - q[1]) for q in (quad, grown)]
            w, h = np.linalg.norm(quad[1] - quad[0]), np.linalg.norm(quad[2] - quad[1])
            d = w * h * pixels.UNCLIP / (2 * (w + h))
            assert np.allclose(sides, [w * h, (w + 2 * d) * (h + 2 * d)])


@settings(deadline=None, max_examples=300)
@given(st.tuples(st.floats(-5, 35), st.floats(-5, 35)), st.tuples(st.floats(0, 20), st.floats(0, 20)), st.floats(0, 7), st.booleans())
def test_quad_score_is_the_mean_of_its_pixels(centre, half, angle, turned_back):
    turn = np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]])
    quad = np.array([[-1, -1], [1, -1], [1, 1], [-1, 1]]) * half @ turn.T + centre
    quad = quad[::-1] if turned_back else quad
    scores = np.random.default_rng(3).random((25, 30)).astype(np.float32)
    low = np.clip(np.floor(quad.min(axis=0)), 0, [29, 24]).astype(int)
    high = np.clip(np.ceil(quad.max(axis=0)), 0, [29, 24]).astype(int)
    corners = np.floor(quad - low + 0.5)
    x, y = np.meshgrid(np.arange(high[0] - low[0] + 1), np.arange(high[1] - low[1] + 1))
    turns = [(c - a) * (y - b) - (d - b) * (x - a) for (a, b), (c, d) in zip(corners, np.roll(corners, -1, axis=0), strict=True)]
    inside = np.all([t >= 0 for t in turns], axis=0) | np.all([t <= 0 for t in turns], axis=0)
    own = scores[low[1] : high[1] + 1, low[0] : high[0] + 1][inside]
    assert abs(pixels.quad_score(scores, quad) - (own.astype(float).mean() if own.size else 0)) < 1e-9


def test_detects_a_drawn_line():
    scores = np.zeros((64, 128), np.float32)
    scores[20:30, 10:90] = 0.8
    [(k, n, quad, score)] = pixels.candidate_quads(scores)
    assert k == 0 and n > 4 and abs(score - 0.8) < 1e-6
    assert np.allclose([quad[:, 0].min(), quad[:, 0].max(), quad[:, 1].min(), quad[:, 1].max()], [10, 89, 20, 29])
    assert pixels.quad_score(scores, quad + 200) <= 0.8


def test_resize_keeps_flat_images_and_sizes():
    image = np.full((31, 17, 3), 77, np.uint8)
    out = pixels.resize(image, 40, 9)
    assert out.shape == (9, 40, 3) and (out == 77).all()
    ramp = np.tile(np.arange(64, dtype=np.uint8)[None, :, None] * 4, (8, 1, 3))
    small = pixels.resize(ramp, 16, 4)
    assert (np.diff(small[0, :, 0].astype(int)) > 0).all()


def test_model_inputs():
    rng = np.random.default_rng(0)
    page = rng.integers(0, 255, (50, 80, 3), dtype=np.uint8)
    x = pixels.layout_input(page)
    assert x["image"].shape == (1, 3, 800, 800) and np.allclose(x["scale_factor"], [[16, 10]])
    assert pixels.det_input(page).shape[2:] == pixels.det_size(80, 50)[::-1]
    groups = list(pixels.rec_batches([page, page[:0], page[:, :20], page[:10]], 2))
    assert [g for g, _ in groups] == [[2, 0], [3]]
    first = groups[0][1]
    assert (first[0, :, :, pixels.rec_input(page[:, :20]).shape[2] :] == 0).all()
    assert pixels.formula_input(page).shape == (1, 1, 384, 384)


def test_crop_margin():
    page = np.full((20, 30), 250, np.uint8)
    assert pixels.crop_margin(page) is page
    page[5:9, 7:12] = 10
    assert pixels.crop_margin(page).shape == (4, 5)


@pytest.mark.parametrize(
    ("kind", "rgb"),
    [("paragraph_title", (220, 20, 60)), ("text", (30, 30, 200)), ("formula", (0, 150, 0)), ("doc_title", (70, 130, 180)), ("figure_title", (70, 130, 180)), ("image", (70, 130, 180))],
)
def test_annotate(kind, rgb):
    from quire.sources.pages import annotate, png, tag

    out = annotate(np.full((80, 160, 3), 255, np.uint8), [(kind, [10, 40, 150, 70])])[:, :, ::-1]
    assert tuple(out[40, 20]) == tuple(out[41, 20]) == rgb and tuple(out[55, 20]) == (255, 255, 255)
    name = tag(kind)
    assert name.any() and name.shape == (10, 8 * len(kind) - 2)
    room = out[26:36, 14 : 14 + name.shape[1]]
    assert (room[name] == 0).all() and (room[~name] == rgb).all()  # black letters on the colour
    assert png(out).startswith(b"\x89PNG")


def test_images_of_a_size_at_once_equal_single_ones():
    rng = np.random.default_rng(4)
    for h, w in ((3, 8), (7, 3), (5, 5)):
        images = rng.integers(0, 256, (40, h, w, 3), dtype=np.uint8)
        images[:5] = 90  # flat
        images[5:20] = 250
        images[5:20, 1 : h - 1, 1 : w - 1] = 30  # with margins
        assert (pixels.resize_all(images, 7, 4) == np.array([pixels.resize(x, 7, 4) for x in images])).all()
        for page, (y1, y2, x1, x2) in zip(pixels.gray(images), pixels.margins(pixels.gray(images)).tolist(), strict=True):
            assert (pixels.crop_margin(page) == page[y1:y2, x1:x2]).all() and pixels.crop_margin(page).shape == (y2 - y1, x2 - x1)
        assert (pixels.formula_inputs(images, side=12) == np.array([pixels.formula_input(x, side=12)[0, 0] for x in images])).all()


def test_rectangles_divide_last():
    """Corners are those of the SQL to the last bit, as halves of them are rounded."""
    rng = np.random.default_rng(8)
    for _ in range(200):
        hull = pixels.convex_hull(rng.integers(0, 180, (9, 2)))
        sides = np.roll(hull, -1, axis=0) - hull
        found = []
        for (ax, ay), (dx, dy) in zip(hull.tolist(), sides.tolist(), strict=True):
            n = np.sqrt(dx * dx + dy * dy)
            u, v = [dx * x + dy * y for x, y in hull.tolist()], [dx * y - dy * x for x, y in hull.tolist()]
            u1, u2, v1, v2 = min(u) / n, max(u) / n, min(v) / n, max(v) / n
            ux, uy = dx / n, dy / n
            corners = [(a * ux - b * uy, a * uy + b * ux) for a, b in ((u1, v1), (u2, v1), (u2, v2), (u1, v2))]
            found.append((round((u2 - u1) * (v2 - v1), 6), ax, ay, corners))
        assert pixels.min_area_quad(hull).tolist() == [list(c) for c in min(found)[3]]


def test_maps_at_once_are_as_one_by_one(monkeypatch):
    from quire.sources import models

    rng, calls, own = np.random.default_rng(3), [], pixels._borders
    maps = np.zeros((12, 30, 40), np.float32)
    for k, m in enumerate(maps[2:]):
        for y, x in rng.integers(0, 30, (4, 2)):
            m[y : y + 5, x : x + 12] = rng.random()
        m[rng.random(m.shape) < 0.02 * k] = 0
    maps[1] = 1  # one map is full, the first is empty
    monkeypatch.setattr(pixels, "_borders", lambda mask: (calls.append(mask.shape), own(mask))[1])
    for most in (3000, 3):
        calls.clear()
        got = models.quad_batches(np.arange(12) * 5, maps, 80, 60, most).to_pylist()
        assert len(calls) == 1
        want = []
        for k, m in enumerate(maps):
            for at, outline in enumerate(pixels.contours(pixels.binarize(m))[:most]):
                if len(outline) >= 4:
                    quad = pixels.min_area_quad(outline)
                    want.append((5 * k, at, len(outline), pixels.quad_score(m, quad)))
        assert [(r["page_id"], r["contour_ord"], r["n_points"]) for r in got] == [w[:3] for w in want]
        assert np.allclose([r["score"] for r in got], [w[3] for w in want]) and len({r["page_id"] for r in got}) > 8
