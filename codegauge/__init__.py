"""codegauge: trust scores for large collections of source code, on Spark."""

from codegauge.analyzers import Analyzer, Registry, line_analyzer, tree_analyzer
from codegauge.functions.syntax import ast_nodes
from codegauge.plans.validate import Validation, validate, validate_texts
from codegauge.session import build_session

__all__ = [
    "Analyzer", "Registry", "Validation", "ast_nodes", "build_session", "line_analyzer", "tree_analyzer",
    "validate", "validate_texts",
]
