"""sarfgrid plans."""
