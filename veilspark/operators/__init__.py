"""DataFrame -> DataFrame operators over document, span and audit tables."""
