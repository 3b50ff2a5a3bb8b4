"""Training-data operators: deduplication, scoring, filtering, tokenising, sharding, packing.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it. The
registered queries and their SQL are in :mod:`foldwise.llm.queries`.
"""
