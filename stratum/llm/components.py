"""Connected components, as the library has them."""

from stratum.operators.components import components  # noqa: F401  for the operators here
