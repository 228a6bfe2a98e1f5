"""Column functions: identifiers, paths, dates, places, types, classification, sidecar names."""
