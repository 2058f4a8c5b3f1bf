"""Operators for preparing text corpora for language-model training.

The subpackage stands alone: nothing else in the library imports it.
"""
