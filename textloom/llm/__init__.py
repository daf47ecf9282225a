"""Training-data operators: filtering, deduplication, formatting and mixing of large text corpora.

Nothing outside this package (and ``corpus_pipeline.py``) imports it; it can be deleted as a whole.
"""
