"""Live questions."""
