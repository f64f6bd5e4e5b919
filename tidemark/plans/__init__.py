"""Set expressions and the catalogue of registered queries."""
