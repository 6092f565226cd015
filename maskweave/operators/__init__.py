"""DataFrame operators: detection, policy, vault, audit, delta scan, scoring, bodies, metrics."""
