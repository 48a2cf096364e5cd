"""Part of orrery."""
