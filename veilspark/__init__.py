"""veilspark: personal-data discovery and protection as Spark DataFrame jobs."""
