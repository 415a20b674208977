"""Functions in Python, over Arrow batches."""
