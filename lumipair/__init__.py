"""Channel co-localization analytics for multi-channel images, on Spark DataFrames."""
