"""Training-data operators: scoring, filtering, search, deduplication and mixing of text corpora.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its queries when it is present.
"""
