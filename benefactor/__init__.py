"""Research-funding analytics on Spark: funder recognition, open-data rates, dashboards, reports."""
