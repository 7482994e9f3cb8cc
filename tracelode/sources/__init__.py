"""Sources, sinks and table maintenance."""
