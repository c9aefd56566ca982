"""Operators for training-data preparation (optional subpackage).

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries
only when the import succeeds.
"""
