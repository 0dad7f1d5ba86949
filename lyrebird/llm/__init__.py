"""Operators for preparing text collections for language-model training.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries only if it can be imported.
"""
