"""Training-data operators: one module per operator, queries in :mod:`motorlens.llm.queries`.

Nothing else in the library imports this subpackage.
"""
