"""Functions of the business-contact library."""
