"""Complete plans: the sync pass, the catalog calls and the driver queries."""
