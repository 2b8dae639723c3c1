"""Every query over the given tables, and its SQL counterpart."""
