"""Tables as data sources, and their mapping onto the play model."""
