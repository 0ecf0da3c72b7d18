"""Training-data operators: token counts, BPE, near-dedup, classifiers, scans and scoring.

Nothing outside this subpackage imports it.
"""
