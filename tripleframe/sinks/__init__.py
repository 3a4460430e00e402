"""Results as JSON, text, graphs and pages."""
