"""Column-level building blocks: text folding, span arrays, fixed patterns."""
