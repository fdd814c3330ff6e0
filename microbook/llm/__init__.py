"""Operators for training-data pipelines over text, pages and archives.

Nothing outside this subpackage (except ``__spark_entry__.py`` and ``corpus_pipeline.py``)
imports it, so it can be removed as a whole.
"""
