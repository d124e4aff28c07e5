"""meterlark: usage analytics for tool logs, written as Spark DataFrame jobs."""

__version__ = "0.1.0"
