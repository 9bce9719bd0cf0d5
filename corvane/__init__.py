"""corvane: deterministic retrieval, evidence and graph analytics over text corpora, on Spark DataFrames."""

__version__ = "0.1.0"
