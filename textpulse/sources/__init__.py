"""Inputs and stored artefacts."""
