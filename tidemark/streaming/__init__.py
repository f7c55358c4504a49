"""Landing raw measurements from a stream."""
