"""DataFrame operators over document evidence."""
