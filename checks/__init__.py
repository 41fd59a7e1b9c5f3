"""Views over the supplied tables, the registered queries and their SQL counterparts."""
