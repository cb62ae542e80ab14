"""Sessions, table access and the registered queries with their SQL twins."""
