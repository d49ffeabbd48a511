"""Operators over text and source code for training-data pipelines."""
