"""Operators that a training-data pipeline needs, each as a Spark job.

Nothing else in the library imports this subpackage.  One module per operator
holds the operator with its general interface; ``queries`` derives the digest
columns of the ``opN_`` queries from it.
"""
