"""Column functions with the number, null and rounding rules of the operators."""
