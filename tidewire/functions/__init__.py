"""Part of the tidewire library."""
