"""Jobs: the registered queries over the given tables, and exports."""
