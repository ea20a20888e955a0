"""Vector geometry: a NumPy kernel on WKB, Arrow functions over it, and cell-based spatial joins."""
