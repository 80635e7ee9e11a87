"""chromaweft: pairwise genomic-interaction analytics on PySpark DataFrames."""
