"""ragbench: DataFrame operators for corpora, retrieval experiments and their analysis on Spark."""
