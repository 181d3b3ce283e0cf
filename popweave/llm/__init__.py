"""Corpus-preparation operators (training-data pipeline components).

Nothing else in the package imports this subpackage; it can be removed as a
whole. ``queries`` registers one driver query per operator.
"""
