"""Column functions: sequences, alignments, signals, labels and calls."""
