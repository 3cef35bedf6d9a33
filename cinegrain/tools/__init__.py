"""Tools: named, parameterised queries over a catalog."""
