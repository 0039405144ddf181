"""Registered queries and the SQL each is checked against.

The supplied tables hold no events, so most queries first write web pages out of their rows (with plain
SQL expressions that Spark and the checking database both understand) and then read the events back out
of the HTML.  The check never sees the HTML: it computes the expected rows from the table itself.
"""
