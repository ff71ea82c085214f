"""Column builders. Everything here stays in the JVM."""
