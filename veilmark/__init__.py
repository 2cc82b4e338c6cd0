"""veilmark: personal-data detection, redaction, policy and scoring as Spark DataFrame jobs."""
