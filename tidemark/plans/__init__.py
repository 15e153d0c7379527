"""Physical layouts and whole jobs composed from operators."""
