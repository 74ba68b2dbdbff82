"""Training-data operators: packing, extraction, scoring, classification, search, deduplication.

Nothing else in the library imports this subpackage; its queries are in ``postloom.llm.queries``.
"""
