"""Column expressions: all JVM-side, no Python per row."""
