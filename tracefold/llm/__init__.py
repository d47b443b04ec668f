"""Training-data operators: media chunks, WARC, dedup, mixing, secrets, counts, PII, BPE, quality.

Nothing outside this subpackage imports it.
"""
