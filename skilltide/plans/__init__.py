"""The chains a user calls."""
