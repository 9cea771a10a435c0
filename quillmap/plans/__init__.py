"""Jobs that chain operators into maps."""
