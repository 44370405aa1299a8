"""Operators for building language-model training data, each as a Spark job.

Nothing outside this subpackage imports it; ``queries`` lists its queries.
"""
