"""Column expressions: clocks, text flags, prices, numeric guards."""
