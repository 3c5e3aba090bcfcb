"""Land-parcel record harmonization on Spark DataFrames."""
