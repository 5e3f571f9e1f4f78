"""Ways to run what a single window or a single aggregate can't: ordered sums of any length, fitting loops, iteration to a fixed point."""
