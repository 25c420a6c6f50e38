"""Transaction-proof analytics as Spark plans."""
