"""Column helpers: states, clocks, numbers and script patterns."""
