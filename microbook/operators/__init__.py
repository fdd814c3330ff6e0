"""DataFrame-to-DataFrame operators, keyed by (stock_id, date)."""
