"""The registered queries and the SQL they are checked against."""
