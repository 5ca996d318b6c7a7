"""Pixel and contour work in numpy, for Arrow operators.

Images are arrays (height, width, channels) of uint8 in BGR order, as Spark's
image source gives them; models want BGR too.
"""

from __future__ import annotations

import numpy as np

from quire.functions.geometry import FORMULA_SIDE, LAYOUT_SIDE, REC_HEIGHT, REC_WIDTH

DET_MEAN = np.array([0.485, 0.456, 0.406], np.float32)
DET_STD = np.array([0.229, 0.224, 0.225], np.float32)
FORMULA_MEAN, FORMULA_STD = 0.7931, 0.1738
BINARY = 0.2
UNCLIP = 1.4
FOREGROUND = 200.0


def round_half_up(x: float) -> int:
    return int(np.floor(x + 0.5))


def _weights(size: int, to: int) -> np.ndarray:
    """(to, size) weights of a triangle filter, widened when shrinking."""
    ratio = size / to
    reach = max(ratio, 1.0)
    centre = (np.arange(to) + 0.5) * ratio
    w = np.maximum(0.0, 1.0 - np.abs(np.arange(size)[None, :] + 0.5 - centre[:, None]) / reach)
    return w / w.sum(axis=1, keepdims=True)


def resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Separable triangle resampling, rounded to uint8; halves go up, whatever the order of sums."""
    if image.shape[1] == width and image.shape[0] == height:
        return image.copy()
    return resize_all(image[None], width, height)[0]


def resize_all(images: np.ndarray, width: int, height: int) -> np.ndarray:
    """`resize` of images (n, height, width, ...) of one size, at once."""
    n, h, w = images.shape[:3]
    if w == width and h == height:
        return images.copy()
    flat = images.reshape(n, h, -1).astype(np.float64)
    tall = (_weights(h, height) @ flat).reshape(n, height, w, -1)
    out = _weights(w, width) @ tall
    return np.clip(np.floor(out + (0.5 + 1e-9)), 0, 255).astype(np.uint8).reshape(n, height, width, *images.shape[3:])


def planes(image: np.ndarray) -> np.ndarray:
    """Channels first, scaled to 0..1."""
    return image.transpose(2, 0, 1).astype(np.float32) / np.float32(255)


def layout_input(image: np.ndarray) -> dict[str, np.ndarray]:
    h, w = image.shape[:2]
    return {
        "image": planes(resize(image, LAYOUT_SIDE, LAYOUT_SIDE))[None],
        "im_shape": np.array([[LAYOUT_SIDE, LAYOUT_SIDE]], np.float32),
        "scale_factor": np.array([[LAYOUT_SIDE / h, LAYOUT_SIDE / w]], np.float32),
    }


def det_size(w: int, h: int, longest: int = 1280) -> tuple[int, int]:
    """As geometry.det_size, for one page."""
    longest = min(4000, max(736, longest))
    ratio = max(1.0, 736 / min(w, h))
    if max(w, h) * ratio > longest:
        ratio = longest / max(w, h)
    return tuple(32 * max(1, round_half_up(v * ratio / 32)) for v in (w, h))


def det_input(image: np.ndarray, longest: int = 1280) -> np.ndarray:
    return det_planes(resize(image, *det_size(image.shape[1], image.shape[0], longest)))[None]


def det_planes(image: np.ndarray) -> np.ndarray:
    """The statistics apply in the order of the image's channels."""
    return (planes(image) - DET_MEAN[:, None, None]) / DET_STD[:, None, None]


def rec_planes(image: np.ndarray) -> np.ndarray:
    return (planes(image) - np.float32(0.5)) / np.float32(0.5)


def rec_width(w: int, h: int) -> int:
    return min(REC_WIDTH, max(1, round_half_up(REC_HEIGHT * w / h)))


def rec_input(crop: np.ndarray) -> np.ndarray:
    h, w = crop.shape[:2]
    return rec_planes(resize(crop, rec_width(w, h), REC_HEIGHT))


def rec_batches(crops: list[np.ndarray], batch: int = 8):
    """(places, input) of batches: sorted by width, padded with 0 to the widest; empty crops are left out."""
    ready = {k: rec_input(c) for k, c in enumerate(crops) if c.size}
    order = sorted(ready, key=lambda k: ready[k].shape[2])
    for at in range(0, len(order), batch):
        group = order[at : at + batch]
        x = np.zeros((len(group), 3, REC_HEIGHT, max(ready[k].shape[2] for k in group)), np.float32)
        for row, k in enumerate(group):
            x[row, :, :, : ready[k].shape[2]] = ready[k]
        yield group, x


def gray(image: np.ndarray) -> np.ndarray:
    """Rec. 709 luma of a BGR image."""
    return np.clip(image.astype(np.float64) @ np.array([0.0722, 0.7152, 0.2126]) + 1e-9, 0, 255).astype(np.uint8)


def crop_margin(page: np.ndarray) -> np.ndarray:
    """The box of pixels darker than 200 after the contrast is stretched; a flat image stays."""
    low, high = int(page.min()), int(page.max())
    if low == high:
        return page
    dark = (page.astype(np.float32) - low) / np.float32(high - low) * 255 < FOREGROUND
    rows, columns = np.flatnonzero(dark.any(axis=1)), np.flatnonzero(dark.any(axis=0))
    return page[rows[0] : rows[-1] + 1, columns[0] : columns[-1] + 1] if len(rows) else page


def margins(pages: np.ndarray) -> np.ndarray:
    """(top, bottom, left, right) of what `crop_margin` leaves of gray pages (n, height, width)."""
    n, h, w = pages.shape
    low, high = (f(axis=(1, 2), keepdims=True).astype(int) for f in (pages.min, pages.max))
    dark = (pages.astype(np.float32) - low.astype(np.float32)) / np.maximum(high - low, 1).astype(np.float32) * 255 < FOREGROUND
    dark |= (low == high) | ~dark.any(axis=(1, 2), keepdims=True)  # such a page stays whole
    rows, columns = dark.any(axis=2), dark.any(axis=1)
    return np.column_stack([rows.argmax(axis=1), h - rows[:, ::-1].argmax(axis=1), columns.argmax(axis=1), w - columns[:, ::-1].argmax(axis=1)])


def formula_input(image: np.ndarray, mean: float = FORMULA_MEAN, std: float = FORMULA_STD, side: int = FORMULA_SIDE) -> np.ndarray:
    return formula_inputs(image[None], mean, std, side)[0][None, None]


def formula_inputs(images: np.ndarray, mean: float = FORMULA_MEAN, std: float = FORMULA_STD, side: int = FORMULA_SIDE) -> np.ndarray:
    """(n, side, side): inputs of images of one size; those of equal margins at once."""
    pages = gray(images)
    canvas = np.full((len(pages), side, side), 255, np.uint8)
    boxes, group = np.unique(margins(pages), axis=0, return_inverse=True)
    for k, (y1, y2, x1, x2) in enumerate(boxes.tolist()):
        own = np.flatnonzero(group.ravel() == k)
        h, w = y2 - y1, x2 - x1
        scale = min(side / w, side / h)
        width, height = (min(side, max(1, round_half_up(v * scale))) for v in (w, h))
        top, left = (side - height) // 2, (side - width) // 2
        canvas[own, top : top + height, left : left + width] = resize_all(pages[own, y1:y2, x1:x2], width, height)
    return (canvas.astype(np.float32) / 255 - np.float32(mean)) / np.float32(std)


# contours and quads


def binarize(scores: np.ndarray, threshold: float = BINARY) -> np.ndarray:
    """A mask with a border of zeros, so that shapes at the edge have outlines."""
    return np.pad(scores > np.float32(threshold), 1)


def _borders(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all border points in the flat mask, border by border, and how many
    points each border has.

    A border is a cycle of edges between a full pixel and an empty one beside it: from
    an edge the outline goes on counter-clockwise, to the full pixel across the corner,
    else to the one ahead, else around the same pixel.  Pixels are 8-connected so, and
    each step to another pixel is a point.  A border's number follows from its first
    edge between two pixels of a row.  Cycles are told apart, and put in order, by
    doubling pointers: some twenty steps over arrays of all edges.
    """
    width, flat = mask.shape[1], mask.ravel()
    ways = np.array([1, -width, -1, width])  # counter-clockwise from the right
    inner = np.zeros_like(flat)  # full pixels among four full ones have no edge
    inner[width:-width] = flat[: -2 * width] & flat[2 * width :] & flat[width - 1 : -width - 1] & flat[width + 1 : mask.size - width + 1]
    full = np.flatnonzero(flat & ~inner)
    places, turns = np.nonzero(~flat[full[:, None] + ways])
    places = full[places]
    if not len(places):
        return places, places
    edges = 4 * places + turns
    ahead = (turns + 1) % 4
    corner, beside = places + ways[turns] + ways[ahead], places + ways[ahead]
    crosses, goes_on = flat[corner], flat[beside]
    to = np.where(crosses, corner, np.where(goes_on, beside, places))
    succ = np.searchsorted(edges, 4 * to + np.where(crosses, (turns + 3) % 4, np.where(goes_on, turns, ahead)))
    # the first edge of each cycle in raster order
    first = np.where(turns == 0, places, np.where(turns == 2, places - 1, mask.size))
    jump = succ
    while True:
        lower = np.minimum(first, first[jump])
        if (lower == first).all():
            break
        first, jump = lower, jump[jump]
    leads = ((turns == 0) & (places == first)) | ((turns == 2) & (places - 1 == first))
    # edges from each to the first one of its cycle
    rest, jump = np.where(leads, 0, 1), np.where(leads, np.arange(len(edges)), succ)
    while not leads[jump].all():
        rest, jump = rest + rest[jump], jump[jump]
    rank = np.where(leads, -mask.size * 4, -rest)
    moves = crosses | goes_on
    wide = np.zeros(mask.size, bool)
    wide[first[moves]] = True
    points = moves | (leads & ~wide[first])  # a lone pixel is a point
    order = np.lexsort((rank[points], first[points]))
    starts = first[points][order]
    return places[points][order], np.diff(np.flatnonzero(np.r_[True, starts[1:] != starts[:-1], True]))


def contours(mask: np.ndarray) -> list[np.ndarray]:
    """Outer and hole borders in raster order of their starts, each followed
    counter-clockwise from there; points are (x, y) without the mask's border of zeros."""
    places, counts = _borders(mask)
    points = np.column_stack([places % mask.shape[1] - 1, places // mask.shape[1] - 1]).astype(float)
    return np.split(points, np.cumsum(counts)[:-1]) if len(counts) else []


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of these sizes: the group and the place in it of every member."""
    group = np.repeat(np.arange(len(counts)), counts)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts)


def _chains(points: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lower hulls of groups of points that are sorted by group, x and y.

    A point that doesn't turn left between its neighbours is no corner, so all of these
    go at once, until none is left.
    """
    while len(points) > 2:
        inner = (group[2:] == group[1:-1]) & (group[:-2] == group[1:-1])
        (ax, ay), (bx, by) = (points[1:-1] - points[:-2]).T, (points[2:] - points[:-2]).T
        gone = inner & (ax * by <= ay * bx)
        if not gone.any():
            break
        keep = np.r_[True, ~gone, True]
        points, group = points[keep], group[keep]
    return points, group


def convex_hulls(points: np.ndarray, group: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Corners of the hulls of `n` groups, group by group, and how many each has; as
    `convex_hull` gives them."""
    order = np.lexsort((points[:, 0], points[:, 1], group))  # of a row only its ends matter
    points, group = points[order], group[order]
    same = (group[1:] == group[:-1]) & (points[1:, 1] == points[:-1, 1])
    ends = ~(np.r_[False, same] & np.r_[same, False])
    points, group = points[ends], group[ends]
    order = np.lexsort((points[:, 1], points[:, 0], group))
    points, group = points[order], group[order]
    once = np.r_[True, (group[1:] != group[:-1]) | (points[1:] != points[:-1]).any(axis=1)]
    points, group = points[once], group[once]
    lower, a = _chains(points, group)
    upper, b = _chains(-points[::-1], n - 1 - group[::-1])
    upper, b = -upper, n - 1 - b
    sizes = np.bincount(group, minlength=n)
    # each chain without its last point, which begins the other
    keep_a, keep_b = np.r_[a[1:] == a[:-1], False], np.r_[b[1:] == b[:-1], False]
    lone = np.flatnonzero(sizes == 1)
    single = np.searchsorted(group, lone)
    corners = np.concatenate([lower[keep_a], upper[keep_b], points[single]])
    owner = np.concatenate([a[keep_a], b[keep_b], lone])
    order = np.argsort(owner, kind="stable")
    return corners[order], np.bincount(owner, minlength=n)


def min_area_quads(corners: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Corners (n, 4, 2) of the smallest rectangles around hulls; one side lies on the hull."""
    n, starts = len(counts), np.cumsum(counts) - counts
    quads = np.zeros((n, 4, 2))
    thin = np.flatnonzero((counts > 0) & (counts < 3))
    quads[thin] = corners[np.column_stack([starts[thin], *[starts[thin] + counts[thin] - 1] * 2, starts[thin]])]
    group, at = _spread(counts)
    sides = corners[starts[group] + (at + 1) % counts[group]] - corners
    lengths = np.sqrt((sides * sides).sum(axis=1))
    usable = np.flatnonzero((counts[group] > 2) & (lengths >= 1e-6))
    if not len(usable):
        return quads
    along, owner = sides[usable] / lengths[usable, None], group[usable]
    across = np.column_stack([-along[:, 1], along[:, 0]])
    side, k = _spread(counts[owner])  # every corner against every side of its hull
    own, begins = corners[starts[owner][side] + k], np.cumsum(counts[owner]) - counts[owner]
    # of whole corners, products with whole sides are exact: only then is divided
    (dx, dy), (x, y) = sides[usable][side].T, own.T
    spans = [f.reduceat(p, begins) / lengths[usable] for p in (dx * x + dy * y, dx * y - dy * x) for f in (np.minimum, np.maximum)]
    areas = np.round((spans[1] - spans[0]) * (spans[3] - spans[2]), 6)  # ties: the side whose first corner is further left, then lower
    order = np.lexsort((*corners[usable].T[::-1], areas, owner))
    best = order[np.r_[True, owner[order][1:] != owner[order][:-1]]]
    for corner, (a, b) in enumerate(((0, 2), (1, 2), (1, 3), (0, 3))):
        quads[owner[best], corner] = spans[a][best, None] * along[best] + spans[b][best, None] * across[best]
    return quads


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Corners of the hull, counter-clockwise in x, y, without collinear ones."""
    own = np.unique(np.asarray(points, float).reshape(-1, 2), axis=0)
    if len(own) < 3:
        return own

    def chain(ordered: list) -> list:
        out: list = []
        for x, y in ordered:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (y - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (x - out[-2][0]):
                del out[-1]
            out.append((x, y))
        return out[:-1]

    corners = own.tolist()
    return np.array(chain(corners) + chain(corners[::-1]))


def min_area_quad(points: np.ndarray) -> np.ndarray:
    """Corners (4, 2) of the smallest rectangle around points."""
    hull = convex_hull(points)
    return min_area_quads(hull, np.array([len(hull)]))[0]


def short_side(quad: np.ndarray) -> float:
    return float(np.hypot(*(np.roll(quad, -1, axis=0) - quad).T).min())


def signed_area(quad: np.ndarray) -> float:
    x, y = quad.T
    return float(x @ np.roll(y, -1) - np.roll(x, -1) @ y) / 2


def unclip_all(quads: np.ndarray, ratio: float = UNCLIP) -> np.ndarray:
    """Quads (n, 4, 2) whose sides are moved outwards by area x ratio / perimeter; a
    degenerate one stays as it is."""
    x, y = quads[..., 0], quads[..., 1]
    areas = (x * np.roll(y, -1, axis=1) - np.roll(x, -1, axis=1) * y).sum(axis=1) / 2
    own = np.where((areas >= 0)[:, None, None], quads, quads[:, [0, 3, 2, 1]])
    sides = np.roll(own, -1, axis=1) - own
    lengths = np.hypot(sides[..., 0], sides[..., 1])
    along = sides / np.maximum(lengths, 1e-30)[..., None]
    normals = np.stack([along[..., 1], -along[..., 0]], axis=-1)
    moved = (own * normals).sum(axis=-1) + (np.abs(areas) * ratio / np.maximum(lengths.sum(axis=1), 1e-30))[:, None]  # each side as normal . p = moved
    before, former = np.roll(normals, 1, axis=1), np.roll(moved, 1, axis=1)  # corners meet the side before and their own
    det = before[..., 0] * normals[..., 1] - before[..., 1] * normals[..., 0]
    good = (lengths.min(axis=1) >= 1e-6) & (np.abs(det) >= 1e-8).all(axis=1)
    det = np.where(good[:, None], det, 1.0)
    grown = np.stack([former * normals[..., 1] - before[..., 1] * moved, before[..., 0] * moved - former * normals[..., 0]], axis=-1) / det[..., None]
    return np.where(good[:, None, None], grown, quads)


def unclip(quad: np.ndarray, ratio: float = UNCLIP) -> np.ndarray:
    return unclip_all(np.asarray(quad, float)[None], ratio)[0]


def _row_span(corners: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last whole x on the left of all sides, on the rows y (last < first
    where there is none); corners (n, 4, 2) are whole, a row of them for every y."""
    low, high = np.full(len(y), -(2**40)), np.full(len(y), 2**40)
    for k in range(4):
        (a, b), (dx, dy) = corners[:, k].T, (corners[:, (k + 1) % 4] - corners[:, k]).T
        reach, by = dx * (y - b), np.where(dy == 0, 1, dy)
        high = np.where(dy > 0, np.minimum(high, a + reach // by), np.where((dy == 0) & (reach < 0), -(2**41), high))
        low = np.where(dy < 0, np.maximum(low, a - (-reach) // by), low)
    return low, high


def quad_scores(scores: np.ndarray, quads: np.ndarray, maps: np.ndarray | None = None) -> np.ndarray:
    """The mean score of the pixels in each convex quad, its outline included; 0 without
    any.  Sums of a row's first pixels give those of any scan line, so that a quad costs
    its rows.  `scores` may be maps of one size (n, height, width), and `maps` each quad's."""
    h, w = scores.shape[-2:]
    if not len(quads):
        return np.zeros(0)
    most = np.array([w - 1, h - 1])
    low = np.clip(np.floor(quads.min(axis=1)), 0, most).astype(np.int64)
    size = np.clip(np.ceil(quads.max(axis=1)), 0, most).astype(np.int64) - low + 1
    corners = np.floor(quads - low[:, None] + 0.5).astype(np.int64)
    quad, y = _spread(size[:, 1])
    spans = [_row_span(c[quad], y) for c in (corners, corners[:, ::-1])]
    # a quad's sides turn left in one of the orders; on both only if it is a line
    empty = [b < a for a, b in spans]
    first = np.where(empty[0], spans[1][0], np.where(empty[1], spans[0][0], np.minimum(spans[0][0], spans[1][0])))
    last = np.where(empty[0], spans[1][1], np.where(empty[1], spans[0][1], np.maximum(spans[0][1], spans[1][1])))
    first, last = np.maximum(first, 0), np.minimum(last, size[quad, 0] - 1)
    some = first <= last
    quad, y, first, last = quad[some], y[some], first[some], last[some]
    sums = np.zeros((scores.size // w, w + 1))
    np.cumsum(scores.reshape(-1, w), axis=1, dtype=np.float64, out=sums[:, 1:])
    row = low[quad, 1] + y + (0 if maps is None else h * maps[quad])
    lines = sums[row, low[quad, 0] + last + 1] - sums[row, low[quad, 0] + first]
    pixels = np.bincount(quad, weights=last - first + 1, minlength=len(quads))
    return np.bincount(quad, weights=lines, minlength=len(quads)) / np.maximum(pixels, 1)


def quad_score(scores: np.ndarray, quad: np.ndarray) -> float:
    return float(quad_scores(scores, np.asarray(quad, float)[None])[0])


def candidates(scores: np.ndarray, most: int = 3000) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(contour_ord, points, quads, scores) of a detector's map, unfiltered but for the
    cap in order of discovery and shapes of under four points."""
    return candidates_all(scores[None], most)[1:]


def candidates_all(scores: np.ndarray, most: int = 3000) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """`candidates` of maps of one size (n, height, width), after the number of their map.

    The maps' masks stand one below the other, with rows of zeros between them, so
    contours come map by map.
    """
    n, (height, width) = len(scores), (k + 2 for k in scores.shape[1:])
    mask = np.pad(scores > np.float32(BINARY), ((0, 0), (1, 1), (1, 1))).reshape(n * height, width)
    places, counts = _borders(mask)
    starts = np.cumsum(counts) - counts
    page = places[starts] // (height * width)
    order = np.arange(len(counts)) - np.searchsorted(page, page)
    own = np.flatnonzero((order < most) & (counts >= 4))
    page, order = page[own], order[own]
    if not len(own):
        return page, order, counts[own], np.zeros((0, 4, 2)), np.zeros(0)
    group, at = _spread(counts[own])
    places = places[starts[own][group] + at]
    points = np.column_stack([places % width - 1, places // width % height - 1]).astype(float)
    quads = min_area_quads(*convex_hulls(points, group, len(own)))
    return page, order, counts[own], quads, quad_scores(scores, quads, page)


def candidate_quads(scores: np.ndarray, most: int = 3000) -> list[tuple[int, int, np.ndarray, float]]:
    """`candidates`, a tuple each."""
    found = candidates(scores, most)
    return [(int(k), int(n), q, float(s)) for k, n, q, s in zip(*found, strict=True)]
