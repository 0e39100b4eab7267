"""Evaluation and training-data operators for language-model provers, on Spark."""
