"""Operators for training-data pipelines; importing the subpackage registers their queries."""

from importlib import import_module

from spanlytics.llm.common import ORACLES, QUERIES

MODULES = ["toxicity", "lines", "jaccard", "decontam", "bpe", "sharding", "quality", "substrings", "langid", "chat", "factor", "resample", "crosstoken"]

for _name in MODULES:
    import_module(f"spanlytics.llm.{_name}")

__all__ = ["ORACLES", "QUERIES"]
