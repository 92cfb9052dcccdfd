"""Knowledge-graph building, retrieval and evaluation as Spark DataFrame jobs."""
