"""A PySpark-native analytics engine: tables, arrays, statistics, strings and dates on DataFrames."""
