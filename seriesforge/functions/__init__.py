"""Column expressions: values, series keys, disclosure policy."""
