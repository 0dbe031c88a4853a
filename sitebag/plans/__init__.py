"""Views over the input tables and the registered queries."""
