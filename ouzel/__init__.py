"""Ouzel: an insight-discovery analytics engine on Spark DataFrames."""
