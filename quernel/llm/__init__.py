"""Operators for training-data pipelines: splitting, residue, batch dedup, conversations, packing, mixing, sentences.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries only if it is there.
"""

QUERY_MODULES = ["quernel.llm.queries"]
