"""Jobs: compositions of operators and sinks that correspond to one user action or schedule."""
