"""sievewright: dataset curation and evaluation analytics on Spark DataFrames."""
