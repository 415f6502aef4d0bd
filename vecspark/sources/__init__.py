"""Durable storage."""
