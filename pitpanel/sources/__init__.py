"""Inputs, adapters and outputs."""
