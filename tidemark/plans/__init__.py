"""Named queries over the given tables, and the batch rebuild of the stored ones."""
