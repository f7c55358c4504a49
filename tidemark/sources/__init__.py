"""Reading, checking and writing batches of measurements."""
