"""Operators of the business-contact library."""
