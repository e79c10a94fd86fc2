"""Find, replace and restore sensitive values and code identifiers in large collections of text, with Spark."""
