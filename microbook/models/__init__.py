"""Sequence classifiers: specifications, NumPy forward passes, training, scoring over DataFrames."""
