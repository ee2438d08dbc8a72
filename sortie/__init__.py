"""sortie: analytics over repeated test campaigns, built on Spark DataFrames."""
