"""The classifier: features, fitting, ranking, abstention."""
