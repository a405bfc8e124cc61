"""panelkit: panel construction and event-study estimation as Spark DataFrame jobs."""
