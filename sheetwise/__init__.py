"""Dataset diagnosis, cleaning and analytics as Spark DataFrame operators."""
