"""sources of larkspur."""
