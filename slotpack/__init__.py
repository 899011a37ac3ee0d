"""slotpack package."""
