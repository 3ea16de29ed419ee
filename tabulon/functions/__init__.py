"""Column functions: elementwise math, comparison, strings, dates, arrays, special functions."""
