"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage; deleting it (together
with ``corpus_pipeline.py``) leaves the rest of the library working.
"""
