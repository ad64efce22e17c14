"""Registered queries; importing a module registers what it holds."""

from importlib import import_module, util

MODULES = (
    "q_universe", "q_market", "q_identity", "q_ratios", "q_spatial", "q_structure", "q_rules",
    "q_comps", "q_models", "q_serve", "q_sources", "q_streaming",
)


def load() -> None:
    for name in MODULES:
        if util.find_spec(f"{__name__}.{name}") is not None:
            import_module(f"{__name__}.{name}")
