"""Scalar building blocks: counter-based random numbers and distribution functions."""
