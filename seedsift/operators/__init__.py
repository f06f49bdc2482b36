"""Labels, learning, scoring, ranking and evaluation, each DataFrame to DataFrame."""
