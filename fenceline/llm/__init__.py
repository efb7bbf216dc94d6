"""Training-data operators: thirteen corpus operators and the queries that apply them.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
