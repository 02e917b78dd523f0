"""Design-of-experiments studies over large tables of detector hits, as Spark DataFrame jobs."""
