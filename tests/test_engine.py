"""The whole engine with models that are plain functions."""

import numpy as np
import pytest

from quire.config import ClassConfig, PageConfig, PipelineError
from quire.plans.recognise import Engine, Models
from quire.sources.pages import annotated_pages, pages_from_arrays, read_markdown, read_pages, write_markdown

SYMBOLS = ["h", "i", "!"]
TOKENS = [f"<{k}>" for k in range(23)] + ["x", "Ġ", "^"]


def layout_model(inputs):
    boxes = np.array([[10, 0.9, 5, 5, 195, 30], [2, 0.8, 5, 40, 195, 95], [2, 0.7, 6, 41, 194, 94], [7, 0.6, 5, 100, 100, 130], [1, 0.9, 110, 100, 190, 130], [2, 0.1, 0, 0, 9, 9]], np.float32)
    return {"fetch_name_0": boxes, "fetch_name_1": np.array([6], np.int32)}


def detection_model(inputs):
    h, w = inputs["x"].shape[2:]
    scores = np.zeros((1, 1, h, w), np.float32)
    for y1, y2 in ((45, 60), (70, 90)):
        scores[0, 0, int(y1 / 140 * h) : int(y2 / 140 * h), int(0.1 * w) : int(0.9 * w)] = 0.9
    return {"fetch_name_0": scores}


def recognition_model(inputs):
    n = len(inputs["x"])
    return {"token_ids": np.tile(np.array([[1, 1, 0, 2, 3]]), (n, 1)), "token_probs": np.full((n, 5), 0.5, np.float32)}


def plain_recognition_model(inputs):
    logits = np.zeros((len(inputs["x"]), 5, 4), np.float32)
    for k, i in enumerate([1, 1, 0, 2, 3]):
        logits[:, k, i] = 0.5
    return {"fetch_name_0": logits}


def formula_model(inputs):
    return {"fetch_name_0": np.array([[0, 23, 25, 24, 23, 2, 23]])}


@pytest.fixture()
def pages(spark):
    return pages_from_arrays(spark, {7: np.full((140, 200, 3), 255, np.uint8), 8: np.full((140, 200, 3), 0, np.uint8)})


def models(**changes):
    return Models(**{"layout": layout_model, "detection": detection_model, "recognition": recognition_model, "symbols": SYMBOLS, "formula": formula_model, "tokens": TOKENS} | changes)


def contents(engine, pages):
    return [(r.paragraph_type, r.content) for r in engine.recognise(pages).where("page_id = 7").orderBy("para_idx").collect()]


def test_all_classes(pages):
    want = [("doc_title", "# hi!"), ("text", "hi!\nhi!"), ("formula", "$$\nx^ x\n$$"), ("image", "")]
    assert contents(Engine(PageConfig(ClassConfig.all()), models()), pages) == want
    assert contents(Engine(PageConfig(ClassConfig.all()), models(recognition=plain_recognition_model)), pages) == want


def test_documents_and_sinks(spark, pages, tmp_path):
    engine = Engine(PageConfig(ClassConfig.all()), models())
    docs = engine.documents(pages)
    assert {r.page_id: r.markdown for r in docs.collect()}[8] == "# hi!\n\nhi!\nhi!\n\n$$\nx^ x\n$$"
    for per_page in (False, True):
        write_markdown(docs, str(tmp_path / f"md{per_page}"), per_page)
        again = read_markdown(spark, str(tmp_path / f"md{per_page}"), per_page).collect()
        assert {r.page_id: r.markdown for r in again} == {r.page_id: r.markdown for r in docs.collect()}
    assert sorted(x.name for x in (tmp_path / "mdTrue").iterdir() if x.is_dir()) == ["page_id=7", "page_id=8"]
    drawn = annotated_pages(pages, engine.recognise(pages)).collect()
    assert len(drawn) == 2
    (tmp_path / "images").mkdir()
    for r in drawn:
        (tmp_path / "images" / f"{r.page_id}.png").write_bytes(r.png)
    again = read_pages(spark, str(tmp_path / "images"))
    assert again.count() == 2 and again.first().image["nChannels"] == 3


def test_without_detection_regions_are_crops(pages):
    engine = Engine(PageConfig(ClassConfig.none().with_enabled("doc_title", True)), models(detection=None, formula=None, tokens=None))
    assert contents(engine, pages) == [("doc_title", "# hi!")]


def test_threshold_and_none(pages):
    sure = PageConfig(ClassConfig.basic()).with_recognition_threshold(0.6)
    assert contents(Engine(sure, models()), pages) == [("doc_title", ""), ("text", "")]
    assert contents(Engine(PageConfig(ClassConfig.none()), Models(layout_model)), pages) == []


def test_timing(pages):
    engine = Engine(PageConfig(), models())
    assert engine.time_stages(pages).keys() == {"layout", "detect", "recognise"} == engine.last_timing.keys()
    assert engine.recognise(pages.limit(0)).count() == 0


def test_times_come_from_the_run(spark, pages):
    import time

    def slow(model, seconds):
        def run(inputs):
            time.sleep(seconds)
            return model(inputs)

        return run

    engine = Engine(PageConfig(ClassConfig.all()), models(layout=slow(layout_model, 0.3), detection=slow(detection_model, 0.2), formula=slow(formula_model, 0.1)))
    engine.recognise(pages)
    rows = {r.page_id: r for r in engine.timings.collect()}
    assert rows.keys() == {7, 8} and all(0.3 <= r.layout < 2 and 0.2 <= r.detect < 2 and 0 < r.recognise < 2 and 0.1 <= r.formula < 2 for r in rows.values())
    assert abs(engine.last_timing["layout"] - sum(r.layout for r in rows.values())) < 1e-9
    quick = Engine(PageConfig(ClassConfig.none()), Models(layout_model))
    quick.recognise(pages)
    assert quick.last_timing["layout"] > 0 and quick.last_timing["detect"] == quick.last_timing["recognise"] == 0


def failing(name, pages=(7, 8)):
    def run(inputs):
        raise RuntimeError(f"no {name}")

    return run


def test_first_error_is_told(pages):
    config = PageConfig(ClassConfig.all())
    with pytest.raises(PipelineError, match="^page 7: layout: RuntimeError: no layout$"):
        Engine(config, models(layout=failing("layout"), detection=failing("detection"))).recognise(pages)
    with pytest.raises(PipelineError, match="^page 7: detection: RuntimeError: no detection$"):
        Engine(config, models(detection=failing("detection"), recognition=failing("text"))).recognise(pages)
    with pytest.raises(PipelineError, match="^page 7: recognition: RuntimeError: no text$"):
        Engine(config, models(recognition=failing("text"), formula=failing("formula"))).recognise(pages)
    with pytest.raises(PipelineError, match="^page 7: formula: "):
        Engine(config, models(formula=failing("formula"))).recognise(pages)
    with pytest.raises(PipelineError, match="on_error"):
        Engine(config, models(), on_error="skip")


def test_errors_are_kept(pages):
    def dark_fails(inputs):
        if inputs["x"].mean() < 0:
            raise ValueError("dark")
        return detection_model(inputs)

    engine = Engine(PageConfig(ClassConfig.all()), models(detection=dark_fails), on_error="keep")
    assert {r.page_id for r in engine.recognise(pages).collect()} == {7}
    assert [tuple(r) for r in engine.errors.collect()] == [(8, "detection: ValueError: dark")]
    engine = Engine(PageConfig(ClassConfig.all()), models(formula=failing("formula")), on_error="keep")
    assert engine.recognise(pages).count() == 0 and {r.page_id for r in engine.errors.collect()} == {7, 8}


def exchanged(df):
    """Columns that any exchange of a plan is given."""
    import re

    text = df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return [re.sub(r"#\d+L?", "", m[1]) for m in re.finditer(r"Exchange\s*\n(?:Input \[\d+\]|Output \[\d+\]): \[(.*?)\]\n", text)]


def test_pixels_are_decoded_once_and_stay_where_they_are(spark, pages, tmp_path):
    from quire.sources import models as runners
    from quire.sources.pages import png
    from quire.sources.store import dealt_by_page, store_pages

    for k, shade in ((1, 255), (2, 0)):
        (tmp_path / f"{k}.png").write_bytes(png(np.full((140, 200, 3), shade, np.uint8)))
    read = read_pages(spark, str(tmp_path))
    stored = store_pages(read, 3)
    for file in tmp_path.iterdir():
        file.unlink()  # nothing decodes these again
    assert dealt_by_page(stored) and not dealt_by_page(pages)
    engine = Engine(PageConfig(ClassConfig.all()), models())
    assert engine.recognise(stored).count() == 8
    seen = engine.look(stored)
    windows = runners.by_page(None, seen.selectExpr("page_id", "0 AS region_idx", "0 AS x", "0 AS y", "5 AS w", "5 AS h"))
    plans = [runners.run_pages(stored, layout_model, detection_model), runners.run_windows(stored, windows, recognition_model, formula_model), annotated_pages(stored, engine.recognise(stored)), engine.documents(stored)]
    assert any(exchanged(p) for p in plans)
    for plan in plans:
        assert not any("image" in columns for columns in exchanged(plan))
    assert any("image" in columns for columns in exchanged(runners.run_windows(pages, windows, recognition_model)))


def test_settings_reach_the_models(spark, pages):
    def detection(inputs):
        assert inputs["x"].shape[2:] == (480, 960)
        return detection_model(inputs)

    def formula(inputs):
        x = inputs["x"]
        assert 100 <= x.min() <= x.max() <= 101 and len(x) == 1  # (v - mean) / std with mean -100 and std 1
        return formula_model(inputs)

    wide = pages_from_arrays(spark, {1: np.zeros((1000, 2000, 3), np.uint8)})
    config = PageConfig(ClassConfig.all()).with_detection_longest(960).with_formula_normalisation(-100.0, 1.0).with_formula_batch(4)
    assert (config.formula_batch, config.with_formula_batch(0).formula_batch) == (4, 1)
    assert Engine(config, models(detection=detection)).lines(wide).count()
    only = PageConfig(ClassConfig.none().with_enabled("formula", True)).with_formula_normalisation(-100.0, 1.0)
    assert contents(Engine(only, models(formula=formula)), pages) == [("formula", "$$\nx^ x\n$$")]


def test_formulas_in_batches_send_an_image_once(spark, pages):
    from quire.sources.models import run_formulas

    def model(inputs):
        return {"fetch_name_0": np.array([[len(inputs["x"]), 23]] * len(inputs["x"]))}

    windows = spark.createDataFrame([(7, k, 0, 0, 20 if k != 2 else 0, 20) for k in range(6)], "page_id long, region_idx int, x int, y int, w int, h int")
    found = run_formulas(pages, windows, model, batch=3)
    assert {r.region_idx: r.token_ids for r in found.collect()} == {0: [3, 23], 1: [3, 23], 2: [], 3: [3, 23], 4: [2, 23], 5: [2, 23]}


def test_one_image():
    from quire.sources.models import recognise_image

    image = np.zeros((48, 100, 3), np.uint8)
    for model in (recognition_model, plain_recognition_model):
        assert recognise_image(image, model, SYMBOLS) == ("hi!", 0.5)
    assert recognise_image(image[:0], recognition_model, SYMBOLS) == ("", 0.0)


def test_yaml_vocabulary(spark, tmp_path):
    pytest.importorskip("yaml")
    from quire.sources.vocabulary import read_yaml_vocabulary

    path = tmp_path / "model.yml"
    path.write_text('PostProcess: {character_dict: {fast_tokenizer_file: {model: {vocab: {"a": 0, "b": 1, "c": 2}}, added_tokens: [{content: "<s>", id: 0}, {content: "<new>", id: 3}]}}}')
    assert sorted((r.token_id, r.token) for r in read_yaml_vocabulary(spark, str(path)).collect()) == [(0, "<s>"), (1, "b"), (2, "c"), (3, "<new>")]


def test_public_names():
    import quire

    assert quire.Engine is Engine and all(getattr(quire, name) for name in quire.__all__)
    with pytest.raises(AttributeError):
        quire.nothing


def test_missing_models():
    with pytest.raises(PipelineError, match="missing required model path: detection"):
        Engine(PageConfig(), Models(layout_model))
    with pytest.raises(PipelineError, match="formula"):
        Engine(PageConfig(ClassConfig.none().with_enabled("formula", True)), Models(layout_model))


def test_stream_of_files(spark, tmp_path):
    from quire.streaming.pages import process, stream_files

    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.md").write_bytes(b"x" * (k + 1))
    process(stream_files(spark, str(tmp_path / "in")), lambda b: b.selectExpr("page_id", "length(content) AS n"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]
