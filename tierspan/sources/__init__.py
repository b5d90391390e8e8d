"""Readers for annotation files, speaker tables and audio."""
