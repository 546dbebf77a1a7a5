"""Identity, settings and a thin request API."""
