"""Scalar functions as Column expressions; Arrow UDFs only where SQL has no form."""
