"""Column functions: shape descriptors, classification, vectors, formats. Operators F1-F51."""
