"""Relational operators: validation, metrics, ranking, folds, tiles."""
