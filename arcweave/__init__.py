"""arcweave: queries over very large typed property graphs, planned by Spark."""
