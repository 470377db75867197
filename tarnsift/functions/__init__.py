"""Scalar rules on columns: cleaning, labels, scores, canonical forms."""
