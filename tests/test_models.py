"""Model files: sent to executors, compact outputs, threads; made by hand, as no tools are here."""

import os

import numpy as np
import pytest

from quire.sources import onnx_graph as graph
from quire.sources.models import OnnxModel, ThreadBudget, recognised, shipped, thread_budget

ort = pytest.importorskip("onnxruntime")


def model_file(version=13, operator="Identity"):
    """A model that gives its input x back as fetch_name_0."""
    dims = b"".join(graph.field(1, graph.field(2, d)) for d in ("n", "t", "c"))
    tensor = graph.field(2, graph.field(1, graph.field(1, graph.FLOAT) + graph.field(2, dims)))
    own = graph._node(operator, ["x"], "fetch_name_0", b"") + graph.field(2, "g")
    own += graph.field(11, graph.field(1, "x") + tensor) + graph.field(graph.OUTPUT, graph.field(1, "fetch_name_0") + tensor)
    return graph.field(1, 8) + graph.field(graph.OPSETS, graph.field(1, "") + graph.field(2, version)) + graph.field(graph.GRAPH, own)


@pytest.mark.parametrize("version", [11, 13, 18, 21])
def test_only_compact_outputs_leave_the_graph(tmp_path, version):
    path = tmp_path / "rec.onnx"
    path.write_bytes(model_file(version))
    x = np.random.default_rng(0).random((2, 5, 7)).astype(np.float32)
    plain, compact = OnnxModel(str(path)), OnnxModel(str(path), compact=True)
    assert set(plain({"x": x})) == {"fetch_name_0"} and set(compact({"x": x})) == {"token_ids", "token_probs"}
    for a, b in zip(recognised(compact, x), recognised(plain, x), strict=True):
        assert (a == b).all()
    twice = graph.with_argmax(graph.with_argmax(path.read_bytes()))
    assert twice == graph.with_argmax(path.read_bytes()) and graph.outputs(twice) == ["fetch_name_0", "token_ids", "token_probs"]


def test_fields_that_are_not_a_model():
    with pytest.raises(ValueError):
        graph.operator_version(graph.field(1, 8))
    with pytest.raises(ValueError):
        list(graph.fields(bytes([0x0B, 0])))


def test_files_reach_executors(spark, tmp_path):
    import pyarrow as pa

    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    for folder, operator in (("a", "Identity"), ("b", "Neg")):
        (tmp_path / folder / "same.onnx").write_bytes(model_file(operator=operator))
    ready = [shipped(spark, OnnxModel(str(tmp_path / f / "same.onnx"))) for f in "ab"]
    assert ready[0].digest != ready[1].digest and shipped(spark, ready[0]) == ready[0] and shipped(spark, min) is min
    for folder in "ab":
        (tmp_path / folder / "same.onnx").unlink()  # executors have no such path

    def run(batches):
        os.chdir("/")
        for _ in batches:
            x = np.ones((1, 1, 1), np.float32)
            yield pa.RecordBatch.from_pydict({"v": [float(m({"x": x})["fetch_name_0"].sum()) for m in ready]})

    assert [r.v for r in spark.range(1).mapInArrow(run, "v double").collect()] == [1.0, -1.0]


def test_a_changed_file_is_told(spark, tmp_path):
    from pyspark import SparkFiles

    path = tmp_path / "m.onnx"
    path.write_bytes(model_file(12))
    ready = OnnxModel(str(path)).shipped(spark)
    assert ready.content() == path.read_bytes()
    copy = SparkFiles.get(f"{ready.digest}.onnx")
    with open(copy, "ab") as file:
        file.write(b"x")
    with pytest.raises(ValueError, match="another"):
        ready.content()
    with open(copy, "wb") as file:  # as Spark sends it to later tasks
        file.write(path.read_bytes())


@pytest.mark.parametrize("wanted", [1, 2, 3, 8, 100])
@pytest.mark.parametrize("cores", [1, 2, 4, 8])
@pytest.mark.parametrize("task_cpus", [1, 2])
@pytest.mark.parametrize("by_stage", [False, True])
def test_threads_never_exceed_cores(wanted, cores, task_cpus, by_stage):
    if task_cpus > cores:
        return
    budget = ThreadBudget.of(wanted, cores, task_cpus, by_stage)
    assert 1 <= budget.threads <= wanted
    assert cores // budget.task_cpus * budget.threads <= cores and budget.task_cpus <= cores
    assert not by_stage or budget.threads == min(wanted, cores)


def test_profile_of_a_stage(spark):
    requests = ThreadBudget.of(4, 8, 1, True).profile().taskResources
    assert requests["cpus"].amount == 4
    budget, profile = thread_budget(spark, 8)  # one machine: stages can't ask for cores
    assert budget.threads == 1 and profile is None
    assert shipped(spark, OnnxModel("unused", 8, digest="d"), budget.threads).threads == 1
