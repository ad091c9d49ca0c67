"""Named queries: the operators bound to tables, and the same in SQL."""
