"""Training-data operators: dedup, packing, mixing, tokens, quality, shards, search, media.

Nothing outside this package imports it; the package imports nothing of the
rest of the library either, so the two can be shipped separately.
"""
