"""Preparing, auditing, profiling and evaluating paired text corpora on Spark."""
