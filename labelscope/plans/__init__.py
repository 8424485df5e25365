"""Plans made of several operators."""
