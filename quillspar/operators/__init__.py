"""DataFrame operators over declared input columns."""
