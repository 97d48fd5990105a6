"""Sources and offline providers."""
