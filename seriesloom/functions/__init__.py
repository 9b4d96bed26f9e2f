"""Column expressions: parsing, dates, and distribution functions. No Python UDFs."""
