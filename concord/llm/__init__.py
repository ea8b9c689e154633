"""Operators for training-data pipelines over document tables. Nothing outside this folder imports it."""
