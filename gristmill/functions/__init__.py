"""See the README for the map from inventory items to functions."""
