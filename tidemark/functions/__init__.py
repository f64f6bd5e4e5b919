"""Period values and the Column expressions that mirror them."""
