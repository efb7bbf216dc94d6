"""Analytics over assembly-like instruction sequences and training corpora, as PySpark plans."""
