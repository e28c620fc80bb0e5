"""Operators of a training-data pipeline: rules, classifiers, joins, tokens, models, files."""
