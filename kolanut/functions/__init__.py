"""Pure ``Column -> Column`` expressions; no Python runs per row."""
