"""The named queries over the test tables and their SQL counterparts."""
