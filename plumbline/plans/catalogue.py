"""All queries of the core, by name, and their SQL."""
from __future__ import annotations

from plumbline.operators import behavior, belief, bursts, composites, evaluate, graphs, hotkeys, models, profile, relational, relations, textsim, trailing
from plumbline.streaming import weekly

FLAGSHIP = "w08_loo_scores"
_MODULES = [hotkeys, trailing, behavior, bursts, relations, evaluate, belief, textsim, profile, relational, graphs, models, composites, weekly]


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.SQL.items()}
