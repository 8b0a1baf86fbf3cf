"""Where rows come from: REST pages, tables, golden sets, settings."""
