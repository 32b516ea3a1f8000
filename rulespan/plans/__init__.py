"""Planning and validating rule trees."""
