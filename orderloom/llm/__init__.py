"""Training-data operators: dedup, packing, archives, search, tokenizers, toxicity, secrets.

Nothing outside this subpackage imports it; see ``queries`` for the registered queries.
"""
