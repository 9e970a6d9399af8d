"""Operators of a training-data pipeline over a table of documents (doc_id, text, lang, source, n_chars).

Each module holds one operator; ``registry`` holds the thin queries.  Nothing else in the package imports
this subpackage.
"""
