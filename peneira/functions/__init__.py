"""Column expressions; nothing here triggers a job or leaves the JVM."""
