"""All registered queries; importing the modules registers them."""

from opinaria.plans import queries_evaluation, queries_features, queries_learning, queries_lexicon, queries_sources, queries_text  # noqa: F401
from opinaria.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
