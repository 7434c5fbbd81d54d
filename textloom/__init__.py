"""Text and graph analytics on Spark: dataflow, wide-row tables, search and link analysis."""
