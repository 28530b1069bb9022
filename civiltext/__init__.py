"""Text-safety corpus building and classifier evaluation on Spark DataFrames."""
