"""Sub-package of ordina."""
