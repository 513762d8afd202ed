"""Data-quality repair of trip-survey records, expressed as Spark DataFrame plans."""
