"""Detection analytics on Spark: every public function maps DataFrames to DataFrames."""
