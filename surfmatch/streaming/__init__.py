"""Resumable intake."""
