"""Functions from columns to columns, and the feature algebra."""
