"""lathe: tabular machine learning and training-data operators, expressed on Spark DataFrames."""
