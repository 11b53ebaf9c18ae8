"""Column functions: classification, paths and formatting, delta coding, hashing."""
