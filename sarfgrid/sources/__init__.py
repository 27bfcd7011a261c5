"""sarfgrid sources."""
