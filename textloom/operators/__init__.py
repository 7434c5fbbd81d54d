"""The dataflow API over DataFrames."""
