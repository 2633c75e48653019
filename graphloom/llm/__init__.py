"""Operators for training-data pipelines over code and text; nothing outside this subpackage imports it."""
