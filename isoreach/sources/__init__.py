"""Readers and writers at the edges of a job."""
