"""Row functions, special functions, and functions of a whole ordered column."""
