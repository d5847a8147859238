"""Training-data operators: cleaning, deduplication, packing, sharding and archiving of text.

Nothing else in :mod:`qcorpus` imports this subpackage.
"""
