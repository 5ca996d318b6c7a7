"""Configuration of a page pipeline."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from quire.functions.pixels import FORMULA_MEAN, FORMULA_STD
from quire.labels import FORMULA, LABELS, MULTI_LINE, TEXT


class PipelineError(Exception):
    """Any failure of a page pipeline: its construction, or the first error of its models."""


@dataclass
class ClassConfig:
    """Which layout classes are kept."""

    enabled: set[str] = field(default_factory=lambda: {"paragraph_title", "text", "doc_title", "abstract", "figure_title"})

    @classmethod
    def basic(cls) -> ClassConfig:
        return cls()

    @classmethod
    def none(cls) -> ClassConfig:
        return cls(set())

    @classmethod
    def all(cls) -> ClassConfig:
        return cls(set(LABELS))

    def is_enabled(self, label: str) -> bool:
        return label in self.enabled

    def set_enabled(self, label: str, on: bool) -> bool:
        """False, and no change, for an unknown label."""
        if label not in LABELS:
            return False
        (self.enabled.add if on else self.enabled.discard)(label)
        return True

    def with_enabled(self, label: str, on: bool) -> ClassConfig:
        """A changed copy; an unknown label changes nothing."""
        out = ClassConfig(set(self.enabled))
        out.set_enabled(label, on)
        return out

    def needs_recognition(self) -> bool:
        return bool(self.enabled & TEXT)

    def needs_detection(self) -> bool:
        return bool(self.enabled & MULTI_LINE)

    def needs_formulas(self) -> bool:
        return FORMULA in self.enabled


def unit(x: float) -> float:
    return min(1.0, max(0.0, x))


@dataclass(frozen=True)
class PageConfig:
    """Thresholds, sizes and batches, with the classes that are kept."""

    classes: ClassConfig = field(default_factory=ClassConfig.basic)
    layout_threshold: float = 0.4
    recognition_threshold: float = 0.0
    recognition_batch: int = 8
    detection_longest: int = 1280
    formula_mean: float = FORMULA_MEAN
    formula_std: float = FORMULA_STD
    formula_batch: int = 1

    def with_detection_longest(self, n: int) -> PageConfig:
        """Pages are scaled until their longer side has about n pixels (736 to 4000) at most."""
        return replace(self, detection_longest=min(4000, max(736, n)))

    def with_formula_normalisation(self, mean: float, std: float) -> PageConfig:
        return replace(self, formula_mean=mean, formula_std=std)

    def with_formula_batch(self, n: int) -> PageConfig:
        return replace(self, formula_batch=max(1, n))

    def with_layout_threshold(self, x: float) -> PageConfig:
        return replace(self, layout_threshold=unit(x))

    def with_recognition_threshold(self, x: float) -> PageConfig:
        return replace(self, recognition_threshold=unit(x))

    def with_recognition_batch(self, n: int) -> PageConfig:
        return replace(self, recognition_batch=max(1, n))


@dataclass(frozen=True)
class ModelPaths:
    """Model and vocabulary files; only the layout model is always needed."""

    layout: str
    detection: str | None = None
    recognition: str | None = None
    dictionary: str | None = None
    formula: str | None = None
    formula_tokens: str | None = None

    def with_text(self, detection: str, recognition: str, dictionary: str) -> ModelPaths:
        return replace(self, detection=detection, recognition=recognition, dictionary=dictionary)

    def with_formula(self, model: str, tokens: str) -> ModelPaths:
        return replace(self, formula=model, formula_tokens=tokens)

    def required(self, name: str) -> str:
        if getattr(self, name) is None:
            raise PipelineError(f"missing required model path: {name}")
        return getattr(self, name)

    def check(self, classes: ClassConfig) -> list[str]:
        """The files that these classes need; a missing one is an error here, not later."""
        names = ["layout"]
        names += ["detection"] if classes.needs_detection() else []
        names += ["recognition", "dictionary"] if classes.needs_recognition() else []
        names += ["formula", "formula_tokens"] if classes.needs_formulas() else []
        return [self.required(n) for n in names]
