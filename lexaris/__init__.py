"""Document analytics on Spark: signatures, matrices, classifiers, evaluation."""

__version__ = "0.1.0"
