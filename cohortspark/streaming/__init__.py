"""Live readings: validation, checks, de-duplication, the state of every patient as a batch fold and as a stream."""
