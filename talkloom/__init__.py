"""Archive consolidation, text concordance and corpus preparation as Spark jobs."""
