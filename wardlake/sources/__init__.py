"""Readers and writers: event channels, the log table, lookup files, snapshots."""
