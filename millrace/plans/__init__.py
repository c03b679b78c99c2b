"""Plans composed of the operators."""
