"""Operators for large-scale training-data pipelines (dedup, quality, tokens, shards, WARC).

Nothing else in the library imports this subpackage.  ``queries.load()`` lists
the registered ``opN_<name>`` queries and their DuckDB SQL where SQL can
express them.
"""
