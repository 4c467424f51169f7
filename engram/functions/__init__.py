"""Scalar functions as column expressions; Catalyst folds them into the surrounding plan."""
