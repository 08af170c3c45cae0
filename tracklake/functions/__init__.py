"""Column functions: spherical geometry, complex numbers, cleaning."""
