"""Loan-portfolio analytics on Spark: DataFrame transforms for cleaning, snapshots, risk metrics, quality and streams."""
