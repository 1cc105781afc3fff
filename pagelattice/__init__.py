"""A PySpark engine that reconciles sets of page references, with operators for training-data pipelines beside it."""
