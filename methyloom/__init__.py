"""PySpark-native analytics for bisulfite sequencing data."""
