"""E-mail threat investigation at table scale, on Spark DataFrames."""
