"""Operators for preparing language-model training data at corpus scale.

Nothing outside this subpackage imports it; it can be deleted together with ``tests/llm`` and
``corpus_pipeline.py`` and the rest of the library keeps working.
"""
