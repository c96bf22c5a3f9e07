"""Operators for building language-model training corpora.

Nothing else in the library imports this subpackage; it can be removed whole
together with ``tests/llm`` and the top-level ``corpus_pipeline.py``.
"""
