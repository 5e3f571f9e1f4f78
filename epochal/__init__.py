"""Event histories, sequences, graphs, intervals and tables of statistics as Spark DataFrame transformations."""
