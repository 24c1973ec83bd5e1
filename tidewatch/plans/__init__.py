"""Query plans: session set-up, shared scratch tables and the catalogue of queries."""
