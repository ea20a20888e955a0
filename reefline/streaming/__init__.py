"""Structured Streaming flows: upserts by micro-batch, and windows with a watermark."""
