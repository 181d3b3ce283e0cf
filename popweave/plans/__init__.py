"""Public API, test views and the catalogue of driver queries."""
