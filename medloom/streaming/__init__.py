"""The note state machine and event counts over streams."""
