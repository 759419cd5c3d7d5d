"""Live refresh of a source tree."""
