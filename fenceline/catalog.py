"""Every registered query of the analytics operators, with its oracle."""

from __future__ import annotations

from fenceline.operators import augment, dedup, detect, factors, features, fusion, gadgets, graph, listings, measures, ngrams, patterns, recombine, reports, robust, rules, selection, semantic, similarity, splits, stacking, subgraphs, variants, windows
from fenceline.sources import sinks
from fenceline.streaming import incremental

_MODULES = (dedup, ngrams, windows, graph, subgraphs, augment, patterns, splits, detect, reports, incremental, features, listings, similarity, fusion, selection, sinks, variants, gadgets, measures, robust, rules, semantic, stacking, recombine, factors)
QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
