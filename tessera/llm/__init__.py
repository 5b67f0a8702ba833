"""Training-data operators: quality ledger, neighbours, packing, near-duplicates, mixing, toxicity,
language-model scores, token files, repeated passages and secrets.

Nothing else in the library imports this subpackage.
"""
