"""loomline: operators that build and audit text corpora on Spark DataFrames."""
