"""Document sources with access rules."""
