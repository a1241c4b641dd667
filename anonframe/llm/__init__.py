"""Corpus operators for preparing language-model training data.

Nothing else in ``anonframe`` imports this subpackage.  Every operator takes
and returns DataFrames; ``queries`` registers one thin query per operator.
"""
