"""nearline package."""
