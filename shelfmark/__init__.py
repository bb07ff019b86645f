"""Catalogue ETL, embedding-table maintenance and exact batch vector search on Spark DataFrames."""
