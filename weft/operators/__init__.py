"""Operators that Spark lacks: scored signals over documents, vectors, graphs, places and nested records.

A signal is a DataFrame (_doc_id BIGINT, _score DOUBLE), at most one row a document; operators take and give signals, so that
text, vector, graph and relational results compose by joins.
"""
