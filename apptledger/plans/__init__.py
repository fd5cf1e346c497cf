"""Named result views and reports."""
