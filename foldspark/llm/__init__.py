"""Training-data operators: near-duplicates, decontamination, secrets, tokens, archives, search and sharding.

Nothing else in the library imports this subpackage.
"""
