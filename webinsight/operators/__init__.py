"""Set-based operators, one module for each domain."""
