"""Sequential models as NumPy step functions; batch and streaming jobs share them."""
