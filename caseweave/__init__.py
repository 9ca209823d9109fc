"""Document and citation analytics as Spark jobs: DataFrames in, DataFrames out."""
