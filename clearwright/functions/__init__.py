"""Column builders: everything here returns a Spark `Column`."""
