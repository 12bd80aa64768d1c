"""Running summaries of record streams."""
