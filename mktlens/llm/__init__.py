"""Operators of a training-data pipeline over documents, pages and embeddings.

Each module is one operator with its own general interface; ``queries`` applies
them to the whole tables with the production parameters. Nothing outside this
subpackage imports it.
"""
