"""Document analytics on Spark."""

from __future__ import annotations

import importlib

#: Where the public names are; a module is imported when one of its names is used.
_NAMES = {
    "ClassConfig": "quire.config",
    "ModelPaths": "quire.config",
    "PageConfig": "quire.config",
    "PipelineError": "quire.config",
    "Engine": "quire.plans.recognise",
    "Models": "quire.plans.recognise",
    "OnnxModel": "quire.sources.models",
    "read_markdown": "quire.sources.pages",
    "read_pages": "quire.sources.pages",
    "write_markdown": "quire.sources.pages",
    "read_symbols": "quire.sources.vocabulary",
    "read_yaml_vocabulary": "quire.sources.vocabulary",
}
__all__ = sorted(_NAMES)


def __getattr__(name: str):
    if name not in _NAMES:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(importlib.import_module(_NAMES[name]), name)
