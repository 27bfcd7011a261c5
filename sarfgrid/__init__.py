"""sarfgrid: rule-based text-morphology analytics expressed as Spark DataFrames."""
