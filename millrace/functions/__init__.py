"""Column functions. They use Spark built-ins only, so that filters on them reach the scan's stage."""
