"""Operators for training-data pipelines: mixing, archives, near-duplicates, scans and classifiers.

Each module holds one operator; ``queries`` applies them to the driver's tables. Nothing else in
the package imports this folder.
"""
