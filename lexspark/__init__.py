"""lexspark: hybrid retrieval and document analytics as plain Spark plans."""
