"""Operators for preparing language-model training text, as Spark jobs over a `documents` table.

Nothing outside this folder (and corpus_pipeline.py) imports it.
"""
