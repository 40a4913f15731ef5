"""Training-data operators: token output, quality, BPE, line and suffix dedup, PII,
toxicity, near-duplicate groups, sharding and decontamination.

Nothing outside this package imports it.
"""
