"""Column expressions: numeric helpers with IEEE results, book layout, date arithmetic."""
