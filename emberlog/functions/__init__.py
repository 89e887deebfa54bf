"""Column builders: text, geometry and scoring expressions."""
