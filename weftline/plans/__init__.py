"""The registered queries, by theme, with their SQL counterparts."""
