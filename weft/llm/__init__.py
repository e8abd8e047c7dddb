"""Operators for training-data pipelines: one module per operator, registered in :mod:`weft.llm.queries`."""
