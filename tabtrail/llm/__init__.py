"""Operators of a training-data pipeline (numbered 1 to 10) and their queries.

Nothing outside this folder, ``tests/llm`` and ``corpus_pipeline.py`` imports it.
"""
