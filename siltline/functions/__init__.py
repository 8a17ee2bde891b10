"""siltline subpackage."""
