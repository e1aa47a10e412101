"""Column functions: hashes, codecs, sketches."""
