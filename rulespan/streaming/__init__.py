"""Structured Streaming: progress counters, replay without repeats, log tails."""
