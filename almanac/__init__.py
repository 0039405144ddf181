"""almanac: calendar events out of tables of already-fetched web pages, on Spark."""
