"""Part of the strandweave package."""
