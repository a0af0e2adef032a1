"""Operators of a training-data pipeline: ten methods, one module each, and their registered queries."""
