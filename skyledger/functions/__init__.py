"""Column expressions used by the jobs; all run inside the JVM."""
