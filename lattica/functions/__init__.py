"""Small dense algebra on the driver and column helpers."""
