"""A log-intelligence engine on PySpark DataFrames."""
