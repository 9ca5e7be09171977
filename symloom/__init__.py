"""Code-structure analytics as Spark jobs: a graph of symbols and references, kept current and queried as DataFrames."""
