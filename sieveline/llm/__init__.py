"""Training-data operators: text and vector jobs written for a cluster.

Nothing else in the library imports this subpackage.
"""
