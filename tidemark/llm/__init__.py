"""Corpus operators for training-data pipelines; nothing outside this subpackage imports it.

Each module holds one operator with its own general interface; ``queries`` holds the thin
``opN_*`` queries and their SQL.
"""
