"""codeweft: source-code and text analytics on PySpark DataFrames."""
