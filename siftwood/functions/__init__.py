"""Column functions, and page-local Python behind Arrow."""
