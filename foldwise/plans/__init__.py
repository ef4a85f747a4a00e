"""Composed evaluations: prepare, validate, materialise, run a fold, assemble, score, report."""
