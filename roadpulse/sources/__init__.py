"""Readers for incident files, incident tables and hot spot exports."""
