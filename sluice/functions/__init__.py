"""Scalar functions: names, numbers, dates, GML literals and plane geometry."""
