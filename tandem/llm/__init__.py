"""Operators for training-data pipelines; nothing else in tandem imports this subpackage."""
