"""Part of brindle."""
