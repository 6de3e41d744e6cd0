"""Functions by name; importing the package registers all of them."""

from pathloom.functions import geo, scalar, udf

__all__ = ["geo", "scalar", "udf"]
