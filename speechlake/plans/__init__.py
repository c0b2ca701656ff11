"""Runnable queries over the given tables; importing this package registers them."""

from speechlake.plans.registry import REGISTRY, Query
from speechlake.plans import alignments, annotations, files, manifests, sequences, signals, statistics, texts

__all__ = ["REGISTRY", "Query"]
