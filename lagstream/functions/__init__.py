"""Algebra on small matrices, scalar functions of features, simulators."""
