"""Spark-native analytics over changed source files and text corpora."""

from thresher.functions.eligibility import Rules, eligible
from thresher.functions.normalize import normalize_js
from thresher.operators.fragments import chunks, fragments, functions_of, problems
from thresher.plans.pipeline import analyse, analyse_changed, analyse_tree, rows_of, stream

__all__ = ["Rules", "analyse", "analyse_changed", "analyse_tree", "chunks", "eligible", "fragments", "functions_of", "normalize_js", "problems", "rows_of", "stream"]
