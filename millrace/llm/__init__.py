"""Training-data operators: deduplication, joins, search, classifiers, packing, mixing, archives.

Nothing outside this subpackage imports it.
"""
