"""Operators for corpora and splits of training data; nothing else in the package imports these."""
