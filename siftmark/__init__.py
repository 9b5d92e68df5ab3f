"""siftmark: weighting, scoring and selecting large text corpora on Spark."""

__version__ = "0.1.0"
