"""Reading, contracts, sinks and table fingerprints."""
