"""Sources and sinks: file readers with fixed schemas, the path registry,
writers, and adapters that present the driver's test tables as the domain
tables."""
