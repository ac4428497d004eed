"""Signed-multiset analytics on Spark: DataFrame flows whose rows carry a multiplicity."""
