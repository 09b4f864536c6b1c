"""DataFrame operators, grouped as in the operator inventory (B-I)."""
