"""A PySpark-native engine for provenance and text lineage over agent transcripts."""

from __future__ import annotations

import importlib

__version__ = "0.2.0"

#: What the package offers at its top, by the module that holds it; modules are loaded when first asked for.
_OFFERED = {
    "Engine": "api", "Config": "api", "main": "api", "Options": "plans.explain", "NoResults": "plans.explain", "SessionNotFound": "plans.explain", "InvalidSpan": "plans.explain",
    "Store": "sources.stores", "union_stores": "sources.stores", "rebuild": "sources.stores", "DIALECTS": "dialects.registry", "normalise": "dialects.normalise", "detect": "sources.detect",
    "Params": "params", "DEFAULT": "params", "dispatch_links": "operators.dispatch", "marker_uuids": "operators.dispatch", "marker_pattern": "operators.dispatch", "query_anchors": "functions.fingerprint",
}
__all__ = sorted(_OFFERED)


def __getattr__(name: str):
    if name not in _OFFERED:
        raise AttributeError(name)
    return getattr(importlib.import_module(f"spanloom.{_OFFERED[name]}"), name)
