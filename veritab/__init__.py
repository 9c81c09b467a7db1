"""veritab: synthetic-table production, repair and fidelity checks on Spark.

Everything is a plain function from DataFrames to DataFrames.  See README.md
for the map from operator ids to functions.
"""
