"""dialogmill: chat training data prepared as Spark DataFrame jobs."""
