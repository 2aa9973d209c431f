"""veilwright: find, reconcile and remove personal data with Spark DataFrames."""
