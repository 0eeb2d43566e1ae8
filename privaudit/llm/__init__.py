"""Training-data operators: ten corpus-scale Spark jobs and their queries."""
