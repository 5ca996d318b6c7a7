import pytest

from quire.config import ClassConfig, ModelPaths, PageConfig, PipelineError
from quire.labels import LABELS


def test_presets():
    assert ClassConfig.basic().enabled == {"paragraph_title", "text", "doc_title", "abstract", "figure_title"}
    assert ClassConfig.all().enabled == set(LABELS)
    assert not ClassConfig.none().enabled


def test_defaults_and_limits():
    config = PageConfig()
    assert (config.layout_threshold, config.recognition_threshold, config.recognition_batch) == (0.4, 0.0, 8)
    config = config.with_layout_threshold(1.5).with_recognition_threshold(-0.5).with_recognition_batch(0)
    assert (config.layout_threshold, config.recognition_threshold, config.recognition_batch) == (1.0, 0.0, 1)


def test_changing_classes():
    classes = ClassConfig.basic().with_enabled("text", False).with_enabled("formula", True).with_enabled("abstract", True)
    assert not classes.is_enabled("text") and classes.is_enabled("formula") and classes.is_enabled("abstract")
    assert not classes.set_enabled("no such class", True)
    assert classes.with_enabled("no such class", True).enabled == classes.enabled
    assert not classes.is_enabled("no such class")


@pytest.mark.parametrize(
    ("label", "needs"), [("paragraph_title", (True, False, False)), ("figure_title", (True, True, False)), ("formula", (False, False, True)), ("image", (False, False, False))]
)
def test_needs(label, needs):
    classes = ClassConfig.none().with_enabled(label, True)
    assert (classes.needs_recognition(), classes.needs_detection(), classes.needs_formulas()) == needs


def test_paths():
    paths = ModelPaths("layout.onnx")
    assert paths.check(ClassConfig.none()) == ["layout.onnx"]
    with pytest.raises(PipelineError, match="missing required model path: detection"):
        paths.check(ClassConfig.basic())
    assert len(paths.with_text("d", "r", "s").with_formula("f", "t").check(ClassConfig.all())) == 6
