"""Spark-first analytics over recorder tracks, text corpora and control logs."""
