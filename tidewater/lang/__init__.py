"""Source text of the dialect: tokens, syntax trees, diagnostics."""
