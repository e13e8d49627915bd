"""What is sequential within one design, as plain functions over NumPy arrays. Points are complex numbers, x + 1j * y, y down."""
