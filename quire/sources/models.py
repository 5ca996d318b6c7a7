"""Model runners: the boundary between pages and raw model rows.

A model is a callable from named arrays to named arrays; everything after it is
DataFrame code.  `OnnxModel` runs a model file, which `shipped` sends to the
executors; recorded rows can take a model's place anywhere, as they are DataFrames
of the same columns.

A page's image is looked at twice: `run_pages` makes boxes and lines of it, and
`run_windows` reads the windows that follow from these, which come to the image (it
isn't shuffled where pages are a table dealt by page_id).  An error of a model is a
value of its page's row, with the stage it came from; the page's later stages are left
out, so that the first error is the one that is told.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import pixels
from quire.sources.onnx_graph import COMPACT, with_argmax
from quire.sources.pages import image_array
from quire.sources.schema import arrow_schema
from quire.sources.store import beside_pages

_SESSIONS: dict[tuple, object] = {}

BOX = "struct<raw_ord:int,label_value:float,score:float,x1:float,y1:float,x2:float,y2:float>"
QUAD = "struct<contour_ord:int,n_points:int,quad:array<struct<x:double,y:double>>,grown:array<struct<x:double,y:double>>,score:double>"
LAYOUT_RAW = "page_id long, raw_ord int, label_value float, score float, x1 float, y1 float, x2 float, y2 float, n_valid int, page_w int, page_h int"
QUAD_RAW = "page_id long, contour_ord int, n_points int, quad array<struct<x:double,y:double>>, grown array<struct<x:double,y:double>>, score double, map_w int, map_h int, page_w int, page_h int"
SEEN = f"page_id long, page_w int, page_h int, n_valid int, boxes array<{BOX}>, map_w int, map_h int, quads array<{QUAD}>, layout_s double, detect_s double, error string"
TOKENS = "page_id long, crop_idx int, token_ids array<bigint>, token_probs array<float>"
FORMULAS = "page_id long, region_idx int, token_ids array<bigint>"
READ = (
    "page_id long, texts array<struct<crop_idx:int,token_ids:array<bigint>,token_probs:array<float>>>, formulas array<struct<region_idx:int,token_ids:array<bigint>>>, "
    "recognise_s double, formula_s double, error string"
)
_CORNERS = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
#: `QUAD_RAW` for Arrow, as executors can't parse it.
QUADS = pa.schema(
    [("page_id", pa.int64()), ("contour_ord", pa.int32()), ("n_points", pa.int32()), ("quad", _CORNERS), ("grown", _CORNERS), ("score", pa.float64())]
    + [(c, pa.int32()) for c in ("map_w", "map_h", "page_w", "page_h")]
)

Model = Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]]


@dataclass(frozen=True)
class OnnxModel:
    """A model file; the session is made where it runs and kept by its worker.

    `compact` is for recognisers that give class scores (steps by classes): the graph
    gets two further outputs, the best class and its score, and only these leave it.
    """

    path: str
    threads: int = 1
    compact: bool = False
    #: Digest of a file that was sent to the executors.
    digest: str | None = None

    def shipped(self, spark: SparkSession) -> OnnxModel:
        """The model with its file sent to every executor, under the name of its digest."""
        with open(self.path, "rb") as file:
            data = file.read()
        digest = hashlib.sha256(data).hexdigest()
        if f"{digest}.onnx" not in {os.path.basename(f) for f in spark.sparkContext.listFiles}:
            copy = os.path.join(tempfile.mkdtemp(prefix="quire-models-"), f"{digest}.onnx")  # Spark sends it from here
            with open(copy, "wb") as file:
                file.write(data)
            spark.sparkContext.addFile(copy)
        return replace(self, digest=digest)

    def content(self) -> bytes:
        """The model's bytes where it runs; a file that was sent has to be the one that was read."""
        path = self.path
        if self.digest:
            from pyspark import SparkFiles

            path = SparkFiles.get(f"{self.digest}.onnx")
        with open(path, "rb") as file:
            data = file.read()
        if self.digest and hashlib.sha256(data).hexdigest() != self.digest:
            raise ValueError(f"{self.path}: the file on this executor is another one")
        return data

    def __call__(self, inputs: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        key = (self.digest or self.path, self.threads, self.compact)
        if key not in _SESSIONS:
            import onnxruntime

            options = onnxruntime.SessionOptions()
            options.intra_op_num_threads = max(1, self.threads)
            options.graph_optimization_level = onnxruntime.GraphOptimizationLevel.ORT_ENABLE_ALL
            data = self.content()
            _SESSIONS[key] = onnxruntime.InferenceSession(with_argmax(data) if self.compact else data, options, providers=["CPUExecutionProvider"])
        session = _SESSIONS[key]
        names = list(COMPACT) if self.compact else [o.name for o in session.get_outputs()]
        return dict(zip(names, session.run(names, inputs), strict=True))


def shipped(spark: SparkSession, model: Model | None, threads: int | None = None) -> Model | None:
    """A model as executors can run it, with at most `threads` threads; other callables stay."""
    if not isinstance(model, OnnxModel):
        return model
    model = model if model.digest else model.shipped(spark)
    return replace(model, threads=max(1, min(model.threads, threads))) if threads else model


@dataclass(frozen=True)
class ThreadBudget:
    """Threads of a session, and the cores that a task with it takes."""

    threads: int
    task_cpus: int

    @staticmethod
    def of(wanted: int, executor_cores: int, task_cpus: int, by_stage: bool) -> ThreadBudget:
        """Sessions of all tasks of an executor together never have more threads than it
        has cores: a stage of models asks for as many cores a task as a session has
        threads, or, where stages can't ask, a session has as many as any task has."""
        threads = max(1, min(wanted, executor_cores))
        if not by_stage:
            return ThreadBudget(min(threads, task_cpus), task_cpus)
        return ThreadBudget(threads, max(threads, task_cpus))

    def profile(self):
        """The resource profile of a stage of models."""
        from pyspark.resource import ResourceProfileBuilder, TaskResourceRequests

        return ResourceProfileBuilder().require(TaskResourceRequests().cpus(self.task_cpus)).build


def thread_budget(spark: SparkSession, wanted: int) -> tuple[ThreadBudget, object | None]:
    """The budget for sessions of `wanted` threads, and the profile of their stages
    (None where they need none, or where the master knows none, as on one machine)."""
    conf, master = spark.sparkContext.getConf(), spark.sparkContext.master
    task_cpus = int(conf.get("spark.task.cpus", "1"))
    by_stage = not master.startswith("local")
    cores = int(conf.get("spark.executor.cores", str(max(1, wanted)) if by_stage else str(spark.sparkContext.defaultParallelism)))
    budget = ThreadBudget.of(wanted, cores, task_cpus, by_stage)
    return budget, budget.profile() if by_stage and budget.task_cpus > task_cpus else None


def _mapped(df: DataFrame, one: Callable[[dict], pa.RecordBatch | list[tuple]], schema: str, profile=None) -> DataFrame:
    """Applies `one` to each row, a row at a time, so that a task holds one page's pixels;
    it gives rows, or a batch of them."""
    fields = arrow_schema(schema)  # here, as executors can't parse it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                found = one(batch.slice(k, 1).to_pylist()[0])
                if isinstance(found, pa.RecordBatch):
                    yield found
                elif found:
                    columns = list(zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

    return df.mapInArrow(run, schema, profile=profile)


# a page at a time


def layout_rows(model: Model, page: np.ndarray) -> tuple[list[tuple], int | None]:
    """Rows (raw_ord, label_value, score, box) of a page, and how many are valid."""
    out = model(pixels.layout_input(page))
    counts = out.get("fetch_name_1")
    valid = int(counts.ravel()[0]) if counts is not None and counts.size else None
    return [(k, *map(float, r[:6])) for k, r in enumerate(out["fetch_name_0"])], valid


def detected(model: Model, page: np.ndarray, longest: int = 1280) -> np.ndarray:
    """The detector's map of a page."""
    scores = model({"x": pixels.det_input(page, longest)})["fetch_name_0"]
    return scores.reshape(-1, *scores.shape[-2:])[0]


def quad_batch(page_id: int, scores: np.ndarray, page_w: int, page_h: int, most: int = 3000) -> pa.RecordBatch:
    """`QUAD_RAW` rows of a detector's map: candidate quads, as found and grown."""
    return quad_batches(np.array([page_id]), scores[None], page_w, page_h, most)


def quad_batches(page_ids: np.ndarray, scores: np.ndarray, page_w: int, page_h: int, most: int = 3000) -> pa.RecordBatch:
    """`quad_batch` of pages of one size, whose maps (n, height, width) are worked on at once."""
    maps, number, points, quads, found = pixels.candidates_all(scores, most)
    n, (map_h, map_w) = len(number), scores.shape[1:]

    def corners(q: np.ndarray) -> pa.Array:
        own = pa.StructArray.from_arrays([pa.array(q[..., k].ravel()) for k in (0, 1)], names=["x", "y"])
        return pa.ListArray.from_arrays(pa.array(np.arange(0, 4 * n + 1, 4), pa.int32()), own)

    columns = [page_ids[maps], number, points, corners(quads), corners(pixels.unclip_all(quads)), found, *(np.full(n, v) for v in (map_w, map_h, page_w, page_h))]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, QUADS, strict=True)], schema=QUADS)


def recognised(model: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token ids and probabilities of a batch; a model without compact outputs is reduced to them."""
    found = model({"x": x})
    if "token_ids" in found:
        return found["token_ids"], found["token_probs"]
    return found["fetch_name_0"].argmax(axis=2), found["fetch_name_0"].max(axis=2)


def text_tokens(model: Model, page: np.ndarray, crops: list[dict], batch: int) -> list[tuple[int, list, list]]:
    """(crop_idx, token_ids, token_probs) of a page's crops; an empty one has no tokens."""
    cut = [page[c["y"] : c["y"] + c["h"], c["x"] : c["x"] + c["w"]] for c in crops]
    out, empty = [], set(range(len(cut)))
    for places, x in pixels.rec_batches(cut, batch):
        for place, a, b in zip(places, *recognised(model, x), strict=True):
            empty.discard(place)
            out.append((crops[place]["idx"], a.tolist(), b.tolist()))
    return out + [(crops[k]["idx"], [], []) for k in sorted(empty)]


def formula_tokens(model: Model, page: np.ndarray, windows: list[dict], mean: float, std: float, batch: int) -> list[tuple[int, list]]:
    """(region_idx, token_ids) of a page's formulas, `batch` at a time."""
    out, some = [], []
    for f in windows:
        own = page[f["y"] : f["y"] + f["h"], f["x"] : f["x"] + f["w"]]
        if own.size:
            some.append((f["idx"], own))
        else:
            out.append((f["idx"], []))
    for at in range(0, len(some), max(1, batch)):
        part = some[at : at + max(1, batch)]
        ids = model({"x": np.concatenate([pixels.formula_input(own, mean, std) for _, own in part])})["fetch_name_0"]
        if ids.ndim != 2 or len(ids) != len(part):
            raise ValueError(f"formula model gave shape {ids.shape}")
        out += [(region, x.tolist()) for (region, _), x in zip(part, ids, strict=True)]
    return out


class _Stages:
    """Runs a page's stages one after the other, with their seconds; after an error, none."""

    def __init__(self):
        self.error: str | None = None
        self.seconds: dict[str, float] = {}

    def run(self, stage: str, work: Callable, otherwise):
        if self.error is not None:
            return otherwise
        began = time.perf_counter()
        try:
            return work()
        except Exception as e:  # noqa: BLE001 a model may raise anything; it is told with its page
            self.error = f"{stage}: {type(e).__name__}: {e}"
            return otherwise
        finally:
            self.seconds[stage] = time.perf_counter() - began


# pages


def run_pages(pages: DataFrame, layout: Model, detection: Model | None = None, longest: int = 1280, profile=None) -> DataFrame:
    """One `SEEN` row of each (page_id, image): boxes, candidate quads, seconds, error.

    A page without pixels has neither boxes nor quads; without `detection` there are no quads.
    """

    def one(row: dict) -> list[tuple]:
        stages = _Stages()
        page = stages.run("image", lambda: image_array(row["image"]), np.zeros((0, 0, 3), np.uint8))
        h, w = page.shape[:2]
        boxes, valid, quads, map_w, map_h = [], None, [], None, None
        if h and w:
            boxes, valid = stages.run("layout", lambda: layout_rows(layout, page), ([], None))
            if detection is not None:
                found = stages.run("detection", lambda: quad_batch(row["page_id"] or 0, detected(detection, page, longest), w, h), None)
                if found is not None and found.num_rows:
                    map_w, map_h = found.column("map_w")[0].as_py(), found.column("map_h")[0].as_py()
                    quads = found.select(["contour_ord", "n_points", "quad", "grown", "score"]).to_pylist()
        names = ("raw_ord", "label_value", "score", "x1", "y1", "x2", "y2")
        return [
            (row["page_id"], w, h, valid, [dict(zip(names, b, strict=True)) for b in boxes], map_w, map_h, quads)
            + (stages.seconds.get("layout"), stages.seconds.get("detection"), stages.error)
        ]

    return _mapped(pages.select("page_id", "image"), one, SEEN, profile)


def layout_of(seen: DataFrame) -> DataFrame:
    """`LAYOUT_RAW` rows of what `run_pages` has seen."""
    rows = seen.select("page_id", "n_valid", "page_w", "page_h", F.explode("boxes").alias("b"))
    return rows.select("page_id", *[F.col(f"b.{c}").alias(c) for c in ("raw_ord", "label_value", "score", "x1", "y1", "x2", "y2")], "n_valid", "page_w", "page_h")


def quads_of(seen: DataFrame) -> DataFrame:
    """`QUAD_RAW` rows of what `run_pages` has seen."""
    rows = seen.select("page_id", "map_w", "map_h", "page_w", "page_h", F.explode("quads").alias("q"))
    return rows.select("page_id", *[F.col(f"q.{c}").alias(c) for c in ("contour_ord", "n_points", "quad", "grown", "score")], "map_w", "map_h", "page_w", "page_h")


def by_page(crops: DataFrame | None, formulas: DataFrame | None) -> DataFrame:
    """(page_id, windows) of crops (crop_idx) and formulas (region_idx) with x, y, w, h."""
    parts = [
        df.select("page_id", F.struct(F.lit(kind).alias("kind"), F.col(key).alias("idx"), "x", "y", "w", "h").alias("window"))
        for df, kind, key in ((crops, "text", "crop_idx"), (formulas, "formula", "region_idx"))
        if df is not None
    ]
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return rows.groupBy("page_id").agg(F.array_sort(F.collect_list("window")).alias("windows"))


def run_windows(
    pages: DataFrame,
    windows: DataFrame,
    recognition: Model | None,
    formula: Model | None = None,
    batch: int = 8,
    mean: float = pixels.FORMULA_MEAN,
    std: float = pixels.FORMULA_STD,
    formula_batch: int = 1,
    profile=None,
) -> DataFrame:
    """One `READ` row of each page that has `windows` (as `by_page` gives them).

    Windows come to the pages, which stay where they are if they are a table dealt by
    page_id.  Crops are batched page by page, so results don't depend on other pages.
    """

    def one(row: dict) -> list[tuple]:
        stages = _Stages()
        page = stages.run("image", lambda: image_array(row["image"]), np.zeros((0, 0, 3), np.uint8))
        crops = [w for w in row["windows"] if w["kind"] == "text"]
        formulas = [w for w in row["windows"] if w["kind"] == "formula"]
        texts = stages.run("recognition", lambda: text_tokens(recognition, page, crops, batch), []) if crops else []
        latex = stages.run("formula", lambda: formula_tokens(formula, page, formulas, mean, std, formula_batch), []) if formulas else []
        return [
            (
                row["page_id"],
                [dict(zip(("crop_idx", "token_ids", "token_probs"), t, strict=True)) for t in texts],
                [dict(zip(("region_idx", "token_ids"), t, strict=True)) for t in latex],
                stages.seconds.get("recognition"),
                stages.seconds.get("formula"),
                stages.error,
            )
        ]

    return _mapped(beside_pages(pages, windows).select("page_id", "image", "windows"), one, READ, profile)


def texts_of(read: DataFrame) -> DataFrame:
    """`TOKENS` rows of what `run_windows` has read."""
    rows = read.select("page_id", F.explode("texts").alias("t"))
    return rows.select("page_id", "t.crop_idx", "t.token_ids", "t.token_probs")


def formulas_of(read: DataFrame) -> DataFrame:
    """`FORMULAS` rows of what `run_windows` has read."""
    return read.select("page_id", F.explode("formulas").alias("f")).select("page_id", "f.region_idx", "f.token_ids")


# one model alone; its errors are the task's


def run_layout(pages: DataFrame, model: Model) -> DataFrame:
    """Raw layout rows of (page_id, image).  A page without pixels has none."""

    def one(row: dict) -> list[tuple]:
        page = image_array(row["image"])
        h, w = page.shape[:2]
        boxes, valid = layout_rows(model, page) if h and w else ([], None)
        return [(row["page_id"], *b, valid, w, h) for b in boxes]

    return _mapped(pages.select("page_id", "image"), one, LAYOUT_RAW)


def run_detection(pages: DataFrame, model: Model, longest: int = 1280) -> DataFrame:
    """Candidate quads, as found and grown, of (page_id, image)."""

    def one(row: dict) -> pa.RecordBatch | list[tuple]:
        page = image_array(row["image"])
        h, w = page.shape[:2]
        return quad_batch(row["page_id"], detected(model, page, longest), w, h) if h and w else []

    return _mapped(pages.select("page_id", "image"), one, QUAD_RAW)


def run_recognition(pages: DataFrame, windows: DataFrame, model: Model, batch: int = 8) -> DataFrame:
    """Token ids and probabilities of the crops (page_id, crop_idx, x, y, w, h)."""
    crops = by_page(windows, None)

    def one(row: dict) -> list[tuple]:
        return [(row["page_id"], *t) for t in text_tokens(model, image_array(row["image"]), row["windows"], batch)]

    return _mapped(beside_pages(pages, crops).select("page_id", "image", "windows"), one, TOKENS)


def run_formulas(
    pages: DataFrame, windows: DataFrame, model: Model, mean: float = pixels.FORMULA_MEAN, std: float = pixels.FORMULA_STD, batch: int = 1
) -> DataFrame:
    """Formula token ids of the windows (page_id, region_idx, x, y, w, h), `batch` at a time."""
    formulas = by_page(None, windows)

    def one(row: dict) -> list[tuple]:
        return [(row["page_id"], *t) for t in formula_tokens(model, image_array(row["image"]), row["windows"], mean, std, batch)]

    return _mapped(beside_pages(pages, formulas).select("page_id", "image", "windows"), one, FORMULAS)


def recognise_image(image: np.ndarray, model: Model, symbols: list[str]) -> tuple[str, float]:
    """Text and confidence of one line's image (BGR); an empty image has neither."""
    text, probs = [], []
    for _, x in pixels.rec_batches([image], 1):
        ids, found = recognised(model, x)
        before = 0
        for i, p in zip(ids[0].tolist(), found[0].tolist(), strict=True):
            if i not in (0, before) and 0 < i <= len(symbols):
                text.append(symbols[i - 1])
                probs.append(p)
            before = i
    return "".join(text), sum(probs) / len(probs) if probs else 0.0
