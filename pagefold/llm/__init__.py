"""Training-data operators (``op1`` .. ``op10``) and the corpus pipeline's parts.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries
only when the package is present.
"""
