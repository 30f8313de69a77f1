"""Operators for building training data from documents and pages at corpus scale."""
