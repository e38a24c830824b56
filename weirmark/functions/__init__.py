"""Column functions; none needs a Python UDF."""
