"""Training-data operators: one module for each operator, its query beside it.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries only if it can be imported.
"""
