"""Order-book and market-data analytics as Spark DataFrame plans."""
