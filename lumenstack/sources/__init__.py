"""Sources and sinks: directories, zips and object stores, byte parsers, the catalog's tables, written archives."""
