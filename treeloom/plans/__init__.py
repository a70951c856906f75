"""Plans: how the given tables play the parts of the model, and one query per operator."""
