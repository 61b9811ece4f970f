"""Tables derived from the given ones, registered queries and their SQL."""
