"""Language data and the functions that classify lines."""
