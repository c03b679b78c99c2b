"""Semi-structured alert messages and result pages to clean, classified postings, on Spark."""
