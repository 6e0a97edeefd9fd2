"""Operators for building training corpora. Nothing else in veilspark imports this subpackage."""
