"""docweave: match relational schemas to document schemas and migrate the data, on Spark."""
