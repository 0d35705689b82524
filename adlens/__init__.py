"""Campaign-performance analytics as Spark DataFrame transformations."""
