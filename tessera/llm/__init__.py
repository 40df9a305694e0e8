"""Operators for preparing training data: language identification, packing, toxicity, byte-level BPE, near and exact
duplicates, sharding, n-gram scoring, repeated lines and exact vector search. Nothing outside this subpackage imports
it."""
