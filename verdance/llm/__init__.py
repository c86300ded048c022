"""Training-data operators.

Nothing outside this subpackage (and the pipeline file at the repository top)
imports it, so it can be removed without touching the rest of the library.
"""
