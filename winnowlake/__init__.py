"""winnowlake: minimizer indexing, ranked threshold queries and rank comparison on Spark."""
