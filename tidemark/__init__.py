"""Change-data-capture tables on Spark: Bronze, Silver and Gold from database change events."""
