"""User-level jobs, one module per business area."""
