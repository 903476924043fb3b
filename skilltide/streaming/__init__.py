"""The chains over micro-batches."""
