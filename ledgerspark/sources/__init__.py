"""Reading, publishing, and the loan book over the driver's tables."""
