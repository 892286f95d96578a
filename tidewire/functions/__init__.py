"""Tidewire."""
