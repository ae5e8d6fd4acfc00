"""Reserved: the linkage flow reads whole tables, so no streaming operator is called for."""
