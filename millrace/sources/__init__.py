"""Messages and pages as DataFrames."""
