"""Plans over whole tables."""
