"""Streams: stateless analysis of messages, windows over events, near-duplicates within a watermark, and upserts."""
