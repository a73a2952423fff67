"""attriq: entity attribution analytics on Spark DataFrames."""
