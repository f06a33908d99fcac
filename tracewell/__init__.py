"""tracewell: PySpark-native analytics for activity logs of software agents."""
