"""The page pipeline: raw model rows to paragraphs and documents."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.config import PageConfig, PipelineError
from quire.labels import FORMULA, TEXT, is_in
from quire.operators import assign, decode, layout, lines, markdown
from quire.sources import models
from quire.sources.store import dealt_by_page, recorded, store_pages

FORMULA_PADDING = 8


def regions_of(boxes: DataFrame, config: PageConfig) -> DataFrame:
    """Filtered boxes to enabled regions in reading order."""
    return layout.reading_order(layout.keep_classes(layout.suppress(boxes), config.classes.enabled))


def text_contents(regions: DataFrame, ordered: DataFrame | None, recognised: Callable[[DataFrame], DataFrame], config: PageConfig, keep: tuple[str, ...] = ()) -> DataFrame:
    """(page_id, region_idx, content) of text regions.

    recognised turns crops (with the line columns `keep`) into rows with text and
    confidence; `ordered` are lines with line_idx, or None where no enabled class
    needs detection.
    """
    text_regions = regions.where(is_in(F.col("label"), TEXT))
    ordered = no_lines(regions.sparkSession) if ordered is None else ordered
    return contents_of(recognised(assign.crops(text_regions, ordered, keep)), config)


def contents_of(recognised: DataFrame, config: PageConfig) -> DataFrame:
    """(page_id, region_idx, content) of crops with text and confidence."""
    kept = markdown.keep_recognised(recognised, config.recognition_threshold)
    return markdown.region_markdown(kept, ["page_id", "region_idx"], "crop_idx").select("page_id", "region_idx", "content")


def no_lines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "page_id long, line_idx int, x1 double, y1 double, x2 double, y2 double")


def paragraphs_of(regions: DataFrame, contents: DataFrame) -> DataFrame:
    """Every region as a paragraph; one without content has the empty string."""
    out = assign.within_page(regions, contents, "region_idx")
    return out.select(
        "page_id",
        F.col("region_idx").alias("para_idx"),
        F.array(*[F.col(c).cast("float") for c in assign.BOX]).alias("bbox"),
        F.col("label").alias("paragraph_type"),
        F.coalesce("content", F.lit("")).alias("content"),
    )


@dataclass
class Models:
    """What runs on pages; a branch that no enabled class needs may be None."""

    layout: models.Model
    detection: models.Model | None = None
    recognition: models.Model | None = None
    symbols: list[str] | None = None
    formula: models.Model | None = None
    tokens: list[str] | None = None


@dataclass
class Engine:
    """Recognises pages (page_id, image) with a configuration and models.

    Models run when a method is called, and what they see and read is recorded as
    tables, once; all that follows is lazy.  Pages that aren't dealt by page_id are
    stored so first (`store_pages`): their images are decoded once, and never shuffled.

    `timings` has the seconds of each page of the last call, `last_timing` the sums of
    layout, detection and text recognition.
    An error of a model ends the call with a `PipelineError` that names the first page
    (by page_id) and its first stage; with `on_error="keep"` such pages have no
    paragraphs, and `errors` has (page_id, error).
    """

    config: PageConfig
    models: Models
    on_error: str = "raise"
    last_timing: dict[str, float] = field(default_factory=dict)
    timings: DataFrame | None = None
    errors: DataFrame | None = None

    def __post_init__(self):
        classes, m = self.config.classes, self.models
        needed = [("detection", classes.needs_detection()), ("recognition", classes.needs_recognition()), ("symbols", classes.needs_recognition())]
        needed += [("formula", classes.needs_formulas()), ("tokens", classes.needs_formulas())]
        for name, need in needed:
            if need and getattr(m, name) is None:
                raise PipelineError(f"missing required model path: {name}")
        if self.on_error not in ("raise", "keep"):
            raise PipelineError(f"on_error is raise or keep, not {self.on_error}")

    def _ready(self, spark: SparkSession, *names: str) -> tuple[list[models.Model | None], object | None]:
        """Models as executors can run them, and the profile of the stage that does."""
        own = [getattr(self.models, n) for n in names]
        wanted = max([m.threads for m in own if isinstance(m, models.OnnxModel)], default=1)
        budget, profile = models.thread_budget(spark, wanted)
        return [models.shipped(spark, m, budget.threads) for m in own], profile

    def look(self, pages: DataFrame) -> DataFrame:
        """`models.SEEN` rows of the pages, recorded: layout and, where an enabled class
        needs it, detection."""
        (layout_model, detection), profile = self._ready(pages.sparkSession, "layout", "detection")
        detection = detection if self.config.classes.needs_detection() else None
        seen = recorded(models.run_pages(pages, layout_model, detection, self.config.detection_longest, profile), "seen")
        self._tell(seen)
        return seen

    def read(self, pages: DataFrame, crops: DataFrame | None, formulas: DataFrame | None) -> DataFrame:
        """`models.READ` rows of the pages that have crops or formulas, recorded."""
        (recognition, formula), profile = self._ready(pages.sparkSession, "recognition", "formula")
        config = self.config
        read = models.run_windows(
            pages, models.by_page(crops, formulas), recognition, formula, config.recognition_batch, config.formula_mean, config.formula_std, config.formula_batch, profile
        )
        read = recorded(read, "read")
        self._tell(read)
        return read

    def _tell(self, rows: DataFrame) -> None:
        found = rows.where("error is not null").select("page_id", "error")
        self.errors = found if self.errors is None else self.errors.unionByName(found)
        if self.on_error == "raise":
            first = found.orderBy("page_id").first()
            if first:
                raise PipelineError(f"page {first.page_id}: {first.error}")

    def regions_of(self, seen: DataFrame) -> DataFrame:
        """Enabled regions in reading order, with the size of their page."""
        boxes = layout.filter_raw(models.layout_of(seen), self.config.layout_threshold)
        sizes = seen.select(F.col("page_id").alias("__page"), "page_w", "page_h")
        regions = regions_of(boxes, self.config)
        return regions.join(sizes, regions.page_id == sizes["__page"]).drop("__page")

    def lines_of(self, seen: DataFrame) -> DataFrame | None:
        """Lines in reading order, or None where no enabled class needs them."""
        if not self.config.classes.needs_detection():
            return None
        quads = lines.filter_quads(models.quads_of(seen))
        return lines.reading_order(lines.quads_to_boxes(quads.withColumn("quad", F.col("grown"))))

    def regions(self, pages: DataFrame) -> DataFrame:
        return self.regions_of(self.look(pages)).drop("page_w", "page_h")

    def lines(self, pages: DataFrame) -> DataFrame | None:
        return self.lines_of(self.look(pages)) if self.config.classes.needs_detection() else None

    def recognise(self, pages: DataFrame) -> DataFrame:
        """Paragraphs of the pages."""
        config, m = self.config, self.models
        text, formula = config.classes.needs_recognition(), config.classes.needs_formulas()
        self.errors = None
        if (text or formula) and not dealt_by_page(pages):
            pages = store_pages(pages)
        seen = self.look(pages)
        sized, crops, formulas, contents = self.regions_of(seen), None, None, None
        regions = sized.drop("page_w", "page_h")
        if text:
            text_regions, ordered = regions.where(is_in(F.col("label"), TEXT)), self.lines_of(seen)
            crops = assign.crops(text_regions, no_lines(pages.sparkSession) if ordered is None else ordered)
            crops = recorded(assign.with_windows(assign.within_page(crops, sized.select("page_id", "region_idx", "page_w", "page_h"), "region_idx", "inner")), "crops")
        if formula:
            formulas = assign.with_windows(sized.where(F.col("label") == FORMULA), FORMULA_PADDING)
        if text or formula:
            read = self.read(pages, crops, formulas)
            self._time(seen, read)
            if text:
                found = assign.within_page(decode.ctc(models.texts_of(read), m.symbols), crops.select("page_id", "crop_idx", "region_idx", "label"), "crop_idx", "inner")
                contents = contents_of(found, config)
            if formula:
                latex = decode.formula(models.formulas_of(read), m.tokens).select("page_id", "region_idx", markdown.formula_markdown(F.col("latex")).alias("content"))
                contents = latex if contents is None else contents.unionByName(latex)
            failed = read.where("error is not null").select(F.col("page_id").alias("__page"))
            if self.on_error == "keep":
                regions = regions.join(failed, regions.page_id == failed["__page"], "left_anti")
        else:
            self._time(seen, None)
            contents = regions.select("page_id", "region_idx", F.lit("").alias("content")).limit(0)
        if self.on_error == "keep":
            failed = seen.where("error is not null").select(F.col("page_id").alias("__page"))
            regions = regions.join(failed, regions.page_id == failed["__page"], "left_anti")
        return paragraphs_of(regions, contents)

    def _time(self, seen: DataFrame, read: DataFrame | None) -> None:
        own = seen.select("page_id", F.coalesce("layout_s", F.lit(0.0)).alias("layout"), F.coalesce("detect_s", F.lit(0.0)).alias("detect"))
        if read is None:
            self.timings = own.withColumns({"recognise": F.lit(0.0), "formula": F.lit(0.0)})
        else:
            later = read.select(F.col("page_id").alias("__page"), F.col("recognise_s").alias("recognise"), F.col("formula_s").alias("formula"))
            self.timings = own.join(later, own.page_id == later["__page"], "left").drop("__page").fillna(0.0, ["recognise", "formula"])
        stages = ("layout", "detect", "recognise")
        sums = self.timings.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in stages]).first()
        self.last_timing = {c: sums[c] for c in stages}

    def documents(self, pages: DataFrame) -> DataFrame:
        return markdown.documents(self.recognise(pages))

    def time_stages(self, pages: DataFrame) -> dict[str, float]:
        """Seconds that the models of each stage took in one run over the pages."""
        self.recognise(pages)
        return self.last_timing
