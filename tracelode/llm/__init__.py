"""Training-data operators: tokenising, scoring, filtering and near-duplicate jobs over document tables."""
