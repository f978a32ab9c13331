"""Training-data operators: decontamination, LM scoring, mixing, dedup, classifiers, joins, token files."""
