"""Sources of the business-contact library."""
