"""Filing analytics as Spark DataFrame operators."""
