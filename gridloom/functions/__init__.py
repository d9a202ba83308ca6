"""Functions of columns: band indices by name, validity of pixels, projections."""

from gridloom.functions.bands import band_function, band_functions, register_band_function

__all__ = ["band_function", "band_functions", "register_band_function"]
