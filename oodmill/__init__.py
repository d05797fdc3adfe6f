"""oodmill: Spark operators for building, auditing and evaluating datasets under distribution shift."""
