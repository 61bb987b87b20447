"""Training-data operators (deduplication, filtering, search, mixing).

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its
queries when the subpackage is present.
"""
