"""placelens: DataFrame operators for repeated 3D observations of places."""
