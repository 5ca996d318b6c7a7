import math

import pytest
from pyspark.sql import functions as F

from quire.functions import geometry
from quire.functions.text import byte_level_text, byte_level_value, utrim
from quire.operators import decode, layout, lines, markdown

BOXES = "page_id long, raw_ord int, score double, label_id int, x1 double, y1 double, x2 double, y2 double"


def boxes(spark, *rows):
    return spark.createDataFrame([(1, k, float(s), i, *map(float, b)) for k, (i, s, b) in enumerate(rows)], BOXES)


def test_duplicates_leave_the_best(spark):
    rows = boxes(spark, (10, 0.67, (100, 100, 500, 160)), (12, 0.66, (100, 100, 500, 160)), (2, 0.60, (102, 101, 498, 159)))
    assert [(r.label_id, r.score) for r in layout.suppress(rows).collect()] == [(10, 0.67)]


def test_distinct_boxes_stay(spark):
    rows = boxes(spark, (2, 0.9, (0, 0, 100, 100)), (4, 0.8, (50, 50, 150, 150)), (0, 0.7, (0, 120, 100, 160)))
    assert layout.suppress(rows).count() == 3


def test_a_suppressed_box_suppresses_nothing(spark):
    rows = boxes(spark, *[(2, s, (0, y, 100, y + 100)) for s, y in ((0.9, 0), (0.8, 5), (0.7, 10))])
    assert sorted(r.raw_ord for r in layout.suppress(rows).collect()) == [0, 2]
    assert sorted(r.raw_ord for r in layout.suppress(layout.suppress(rows).drop("nms_rank")).collect()) == [0, 2]


def test_nan_scores_come_first_and_ties_keep_their_order(spark):
    rows = boxes(spark, (1, 0.5, (0, 0, 10, 10)), (2, 0.5, (0, 0, 10, 10)), (3, math.nan, (50, 0, 60, 10)))
    assert [r.raw_ord for r in layout.suppress(rows).orderBy("nms_rank").collect()] == [2, 0]


def test_float_thresholds_compare_as_floats(spark):
    raw = spark.createDataFrame([(1, 0, 2.0, 0.4, 0.0, 0.0, 5.0, 5.0, None, 10, 10)], "page_id long, raw_ord int, label_value float, score float, x1 float, y1 float, x2 float, y2 float, n_valid int, page_w int, page_h int")
    assert layout.filter_raw(raw, 0.4).count() == 1
    assert layout.filter_raw(raw.withColumn("label_value", F.lit(float("inf")).cast("float")), 0.4).count() == 0
    assert layout.filter_raw(raw.withColumn("label_value", F.lit(float("nan")).cast("float")), 0.4).first().label_id == 0


def test_line_order_stops_at_the_first_that_stays(spark):
    rows = [(1, 0, 50.0, 100.0, 60.0, 110.0), (1, 1, 30.0, 105.0, 40.0, 115.0), (1, 2, 10.0, 112.0, 20.0, 122.0)]
    df = spark.createDataFrame(rows, "page_id long, line_ord int, x1 double, y1 double, x2 double, y2 double")
    assert [r.line_ord for r in lines.reading_order(df).orderBy("line_idx").collect()] == [1, 0, 2]


def test_empty_tables(spark):
    none = boxes(spark).withColumn("label", F.lit("text"))
    assert layout.reading_order(layout.suppress(none)).count() == 0
    assert lines.reading_order(none.withColumn("line_ord", F.col("raw_ord"))).count() == 0


@pytest.mark.parametrize(("w", "h", "want"), [(800, 600, (992, 736)), (1224, 1584, (992, 1280)), (100, 2000, (64, 1280)), (640, 480, (992, 736)), (2480, 3508, (896, 1280)), (20, 20, (736, 736)), (4000, 10, (1280, 32))])
def test_det_size(spark, w, h, want):
    from quire.functions import pixels

    a, b = geometry.det_size(F.lit(w), F.lit(h))
    assert tuple(spark.range(1).select(a, b).first()) == want == pixels.det_size(w, h)


def test_recognition_width(spark):
    got = [spark.range(1).select(geometry.recognition_width(F.lit(w), F.lit(h))).first()[0] for w, h in ((320, 48), (1000, 30), (100000, 48), (1, 1000))]
    assert got == [320, 1600, 3200, 1]


def test_iou(spark):
    a, b = (F.struct(*[F.lit(float(v)).alias(n) for v, n in zip(x, ("x1", "y1", "x2", "y2"), strict=True)]) for x in ((100, 100, 500, 160), (102, 101, 498, 159)))
    assert round(spark.range(1).select(geometry.iou(a, b)).first()[0], 3) == 0.957


def test_ctc(spark):
    df = spark.createDataFrame([([0, 1, 1, 0, 1, 2, 2, 3], [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]), ([0, 0], [0.9, 0.9]), ([], []), ([1, 9, 1, -4], [0.5, 0.9, 0.25, 0.1])], "token_ids array<bigint>, token_probs array<double>")
    got = [(r.text, round(r.confidence, 9)) for r in decode.ctc(df, ["a", "b", "c"]).collect()]
    assert got == [("aabc", 0.525), ("", 0.0), ("", 0.0), ("aa", 0.375)]


def test_argmax(spark):
    df = spark.createDataFrame([([[0.1, 0.7, 0.7], [math.nan, 0.2, 0.1], [math.nan, math.nan, math.nan]],)], "probs array<array<double>>")
    assert decode.compact(df).first().token_ids == [1, 1, 0]


def test_formula_ids(spark):
    ids = F.array(*[F.lit(x).cast("long") for x in (0, 5, 23, 30, 2, 40)])
    assert spark.range(1).select(decode.formula_ids(ids, 50)).first()[0] == [23, 30]
    assert spark.range(1).select(decode.formula_ids(ids, 30)).first()[0] == [23]


def test_byte_letters(spark):
    codes = [0x120, 0x10A, 0x121, 0x122, 0x142, 0x143, 0x144]
    got = spark.range(1).select(*[byte_level_value(F.lit(c)).alias(str(c)) for c in codes]).first()
    assert list(got) == [32, 10, 127, 128, 160, 173, 0]
    text = "a" + chr(0xE2) + chr(0x122 + 2) + "b"
    assert spark.range(1).select(byte_level_text(F.lit(text))).first()[0].startswith("a")


def test_trim(spark):
    got = spark.range(1).select(utrim(F.lit("　\ta\u0085")), utrim(F.lit("a​"))).first()
    assert list(got) == ["a", "a​"]


def test_paragraphs(spark):
    rows = [(1, 0, "doc_title", "Hello"), (2, 0, "paragraph_title", "Hello"), (3, 1, "text", "b"), (3, 0, "text", "a")]
    df = spark.createDataFrame(rows, "region_id int, o int, label string, text string")
    got = {r.region_id: r.content for r in markdown.region_markdown(df, ["region_id"], "o").collect()}
    assert got == {1: "# Hello", 2: "## Hello", 3: "a\nb"}
    assert spark.range(1).select(markdown.formula_markdown(F.lit(" x ")), markdown.formula_markdown(F.lit("　"))).first()[:] == ("$$\nx\n$$", "")


def test_nan_confidence_is_dropped(spark):
    df = spark.createDataFrame([("a", math.nan), ("b", 0.5), (" ", 0.9), ("c", 0.1)], "text string, confidence double")
    assert [r.text for r in markdown.keep_recognised(df, 0.5).collect()] == ["b"]


def test_vocabulary(spark, tmp_path):
    from quire.sources import vocabulary

    path = tmp_path / "d.txt"
    path.write_bytes("a\n　\r\n \n".encode())
    assert vocabulary.read_symbols(str(path)) == ["a", "　", " "]
    vocab = spark.createDataFrame([(0, "x"), (1, "y")], "token_id int, token string")
    added = spark.createDataFrame([(1, "z"), (2, "w")], "token_id int, token string")
    assert [r.token for r in vocabulary.vocabulary_lines(vocabulary.overlay_vocabulary(vocab, added)).collect()] == ["x", "z", "w"]
    with pytest.raises(ValueError, match="contiguous"):
        vocabulary.overlay_vocabulary(vocab, added.where("token_id = 2").withColumn("token_id", F.lit(7)))


def test_symbol_files_of_any_store(spark, tmp_path):
    from quire.sources.vocabulary import read_symbol_table, read_symbols

    for k, data in enumerate(["a\n\u3000\n \nb\r\n\n", "one", "", "\n", "x\r\r\ny\n\r\n"]):
        path = tmp_path / f"{k}.txt"
        path.write_bytes(data.encode())
        want = read_symbols(str(path))
        assert [(r.id, r.symbol) for r in read_symbol_table(spark, str(path), 1).orderBy("id").collect()] == list(enumerate(want, 1))
