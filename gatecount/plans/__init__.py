"""Plans on the supplied tables, and the composite report and cycle."""
