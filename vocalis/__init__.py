"""Speech and transcript analytics as Spark DataFrame operators."""
