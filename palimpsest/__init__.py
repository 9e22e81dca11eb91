"""Text overlap, document quality and check accounting as Spark jobs."""
