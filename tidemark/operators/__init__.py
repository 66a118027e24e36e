"""Operators on series: time grid, features, labels, signals, evaluation, drift, splits and models."""
