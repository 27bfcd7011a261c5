"""sarfgrid streaming."""
