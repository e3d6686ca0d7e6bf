"""Column functions: ids, text, vectors, codes and stable pseudo-random order."""
