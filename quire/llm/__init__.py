"""Training-data operators: deduplication, tokenising, packing, scoring, chat and media columns.

Nothing outside this subpackage imports it. Each module holds one operator; ``queries`` holds the
thin registered queries over the standard tables.
"""
