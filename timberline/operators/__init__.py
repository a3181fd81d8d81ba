"""DataFrame operators over lines and entries."""
