"""Change-aware analytics on large corpora and event logs, written as Spark DataFrame programs."""
