"""gatecount: analytics over repeated readings of cumulative counters, on Spark."""
