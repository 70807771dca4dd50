"""Matrix decompositions over joins, on Spark."""
