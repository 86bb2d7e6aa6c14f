"""Reading tables and catalogs, and writing series, samples and results."""
