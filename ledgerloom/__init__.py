"""Document-field extraction, evaluation and corpus building as Spark DataFrame transformations."""
