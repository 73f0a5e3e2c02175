"""Named queries over the tables; importing a module registers its queries."""

from importlib import import_module

MODULES = ["corpus", "scoring", "statistics", "annotation", "articles"]


def load_all() -> None:
    for name in MODULES:
        import_module(f"spanlytics.plans.{name}")
