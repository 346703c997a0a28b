"""Table, text and stream operators for everyday data-platform work on Spark.

Every operator is a plain function over DataFrames or Columns; Catalyst picks the physical plan.
"""
