"""Plans that Catalyst can't find by itself."""
