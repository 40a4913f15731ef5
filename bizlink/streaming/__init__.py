"""Streaming of the business-contact library."""
