"""Training-data operators: chat rendering, dedup, packing, media, quality, mixing, token files.

Nothing outside this subpackage imports it.
"""
