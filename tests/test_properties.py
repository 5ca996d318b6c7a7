"""Folds and joins against plain versions on random pages."""

import numpy as np
import pytest

from quire.operators import assign, layout, lines

BOX = "x1 double, y1 double, x2 double, y2 double"


@pytest.fixture(scope="module")
def pages():
    rng = np.random.default_rng(11)
    out = []
    for page in range(30):
        for k in range(int(rng.integers(0, 25))):
            x, y, w, h = (int(v) for v in rng.integers([0, 0, 20, 8], [300, 80, 200, 60]))
            out.append((page, k, float(x), float(y), float(x + w), float(y + h)))
    return out


def of_page(rows, page):
    return [r for r in rows if r[0] == page]


def bubbled(rows):
    """Reading order by swapping neighbours, one line at a time."""
    done = sorted(rows, key=lambda r: (r[3], r[2], r[1]))
    for i in range(1, len(done)):
        for j in range(i, 0, -1):
            if abs(done[j][3] - done[j - 1][3]) < 10 and done[j][2] < done[j - 1][2]:
                done[j], done[j - 1] = done[j - 1], done[j]
            else:
                break
    return [r[1] for r in done]


def test_line_order(spark, pages):
    got = lines.reading_order(spark.createDataFrame(pages, f"page_id long, line_ord long, {BOX}")).collect()
    for page in range(30):
        own = sorted((r for r in got if r.page_id == page), key=lambda r: r.line_idx)
        assert [r.line_idx for r in own] == list(range(len(own)))
        assert [r.line_ord for r in own] == bubbled(of_page(pages, page))


def overlap(a, b):
    w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
    inter = max(w, 0) * max(h, 0)
    return inter / ((a[4] - a[2]) * (a[5] - a[3]) + (b[4] - b[2]) * (b[5] - b[3]) - inter)


@pytest.mark.parametrize("threshold", [0.9, 0.3])
def test_suppression(spark, pages, threshold):
    rows = [(*r, float(r[1] % 5) / 5) for r in pages]
    got = layout.suppress(spark.createDataFrame(rows, f"page_id long, raw_ord long, {BOX}, score double"), threshold).collect()
    for page in range(30):
        kept = []
        for r in sorted(of_page(rows, page), key=lambda r: (-r[6], r[1])):
            if all(overlap(k, r) < threshold for k in kept):
                kept.append(r)
        own = sorted((r for r in got if r.page_id == page), key=lambda r: r.nms_rank)
        assert [r.raw_ord for r in own] == [k[1] for k in kept]


def test_assignment_and_crops(spark, pages):
    regions = [(p, k, "text", x, y, x2 + 40, y2 + 40) for p, k, x, y, x2, y2 in pages if k < 8]
    regions_df = spark.createDataFrame(regions, f"page_id long, region_idx long, label string, {BOX}")
    lines_df = spark.createDataFrame(pages, f"page_id long, line_idx long, {BOX}")
    want = {}
    for p, k, x1, y1, x2, y2 in pages:
        cx, cy = (x1 + x2) / 2, (y1 + y2) / 2
        held = [((r[5] - r[3]) * (r[6] - r[4]), r[1]) for r in regions if r[0] == p and r[3] <= cx <= r[5] and r[4] <= cy <= r[6]]
        if held:
            want[p, k] = min(held)[1]
    got = assign.assign_lines(lines_df, regions_df).collect()
    assert {(r.page_id, r.line_idx): r.region_idx for r in got} == want and len(got) == len(want)
    crops = assign.crops(regions_df, lines_df).collect()
    assert sum(not r.is_fallback for r in crops) == len(want)
    used = {(p, r) for (p, _), r in want.items()}
    assert {(r.page_id, r.region_idx) for r in crops if r.is_fallback} == {(r[0], r[1]) for r in regions} - used
    for page in range(30):
        own = sorted((r for r in crops if r.page_id == page), key=lambda r: r.crop_idx)
        order = [(r.region_idx, -1 if r.line_idx is None else r.line_idx) for r in own]
        assert order == sorted(order) and [r.crop_idx for r in own] == list(range(len(own)))


def test_width_batches(spark):
    rng = np.random.default_rng(3)
    rows = [(int(g), k, int(w)) for k, (g, w) in enumerate(zip(rng.integers(0, 4, 90), rng.integers(1, 50, 90), strict=True))]
    got = assign.width_batches(spark.createDataFrame(rows, "page long, key long, width int"), "key", "page", 8).collect()
    for g in range(4):
        own = sorted(((w, k) for p, k, w in rows if p == g))
        for at in range(0, len(own), 8):
            batch = own[at : at + 8]
            found = {(r.width, r.key, r.pad_width) for r in got if r.page == g and r.batch_no == at // 8}
            assert found == {(w, k, batch[-1][0]) for w, k in batch}


def test_batches_of_images_need_no_whole_group(spark, monkeypatch, tmp_path):
    """Blocks of keys are numbered apart, and a row of images holds one batch."""
    import numpy as np

    from quire import queries
    from quire.operators import assign

    monkeypatch.setattr(assign, "BLOCK", 7)
    rng = np.random.default_rng(2)
    rows = [(int(k), int(k % 3), int(w)) for k, w in enumerate(rng.integers(1, 5, 200))]
    got = {r.k: r.batch_no for r in assign.batch_numbers(spark.createDataFrame(rows, "k long, g long, width int"), "k", "g", 8).collect()}
    for g in range(3):
        for at, (k, _, _) in enumerate(sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0]))):
            assert got[k] == at // 8
    spark.range(300).withColumnRenamed("id", "p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    most = []
    collect_list = queries.F.collect_list
    monkeypatch.setattr(queries.F, "collect_list", lambda c: most.append(1) or collect_list(c))
    plan = queries.image_batches(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert most and "Aggregate [grp" in plan and "batch_no" in plan.split("Aggregate [grp")[1].split("]")[0]
