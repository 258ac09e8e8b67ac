"""Plan helpers: skewed joins and lineage cuts."""
