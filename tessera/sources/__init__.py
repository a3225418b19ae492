"""Sources and sinks that Spark has no format for."""
