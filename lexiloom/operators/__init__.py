"""Preparation, aggregation, encoding, reduction, modelling and evaluation."""
