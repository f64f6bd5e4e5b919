"""Set operators over membership tables: (event, gran, period_start, period_key, id)."""
