"""Structured Streaming forms of the event-shaped inputs."""
