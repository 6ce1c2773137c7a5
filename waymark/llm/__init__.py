"""Operators on the free text and the vectors of a landmark corpus: reviewers' notes, beat vectors, pages.

Nothing else in the library imports this subpackage.
"""
