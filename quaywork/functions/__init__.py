"""Column expressions without state: text, dates, numbers."""
