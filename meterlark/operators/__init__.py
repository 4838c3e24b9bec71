"""Reusable DataFrame operators: one function takes frames and gives a frame."""
