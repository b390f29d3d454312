"""Column functions: text, identifiers, time, scoring. All stay in the JVM."""
