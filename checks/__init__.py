"""The operators run on the driver's tables, with the same questions asked in SQL."""
