"""Operators that prepare text corpora for model training, each a Spark job."""
