"""Plans of the business-contact library."""
