"""Training-data operators: extraction, scoring, filtering, deduplication, tokenizing.

Nothing outside this subpackage imports it; its queries are in ``docloom.llm.queries``.
"""
