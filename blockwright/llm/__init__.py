"""Training-data operators: tokenising, filtering, deduplication and extraction over whole text tables.

Nothing outside this subpackage imports it; the driver contract adds its queries only when it is present.
"""
