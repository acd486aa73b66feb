"""Column functions: text scoring, identifiers, JSON, calibration arithmetic."""
