"""Loan-portfolio analytics and scoring as PySpark DataFrame operators."""
