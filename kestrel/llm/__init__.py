"""Training-data operators: ten document operators, their queries and the corpus pipeline's parts.

Nothing else in the library imports this subpackage.
"""
