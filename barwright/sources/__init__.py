"""Readers and writers of ticks, bars and event logs."""
